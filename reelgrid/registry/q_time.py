"""Time, rate and identity expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgrid.functions import identity as ident
from reelgrid.functions import timebase as tb
from reelgrid.operators.catalog import camera_factor, next_serial
from reelgrid.registry import query

# The rate used by the row, from its event number: the house rates of the fixtures.
RATE_SPARK = {
    "num": "case event_id % 4 when 0 then 50 when 1 then 25 when 2 then 30000 else 60000 end",
    "den": "case when event_id % 4 in (2, 3) then 1001 else 1 end",
}
RATED = """rated as (select *, cast(case event_id%4 when 0 then 50 when 1 then 25 when 2 then 30000 else 60000 end as hugeint) num,
    cast(case when event_id%4 in (2,3) then 1001 else 1 end as hugeint) den, cast(tai_ns as hugeint) ns from frames)"""


def rated(t):
    return t.frames.selectExpr("event_id", "tai_ns", f"{RATE_SPARK['num']} num", f"{RATE_SPARK['den']} den")


@query(
    "ts_to_index",
    f"""with {RATED} select event_id, cast((ns*num+500000000*den)//(1000000000*den) as bigint) grain from rated""",
    "frames",
)
def _(t):
    return rated(t).select("event_id", tb.ts_to_index("tai_ns", "num", "den").alias("grain"))


@query(
    "index_to_ts",
    f"""with {RATED}, g as (select event_id, num, den, (ns*num+500000000*den)//(1000000000*den) ix from rated)
    select event_id, cast((ix*den*1000000000+num//2)//num as bigint) start_ns from g""",
    "frames",
)
def _(t):
    return rated(t).select(
        "event_id", tb.index_to_ts(tb.ts_to_index("tai_ns", "num", "den"), "num", "den").alias("start_ns")
    )


@query(
    "frame_period_ns",
    f"""with {RATED} select event_id, cast((den*1000000000+num//2)//num as bigint) period_ns from rated""",
    "frames",
)
def _(t):
    return rated(t).select("event_id", tb.frame_period_ns("num", "den").alias("period_ns"))


@query(
    "timecode",
    f"""with {RATED}, s as (select *, ns//1000000000 sec from rated),
    f as (select *, (ns*num+500000000*den)//(1000000000*den) - (sec*1000000000*num+500000000*den)//(1000000000*den) ff0,
        (num+den//2)//den nominal from s)
    select event_id, strftime(make_timestamp(cast(sec*1000000 as bigint)), '%H:%M:%S')
        || case when event_id%3=0 then ';' else ':' end
        || lpad(cast(cast(case when ff0>=nominal then ff0%nominal else ff0 end as int) as varchar), 2, '0') tc from f""",
    "frames",
)
def _(t):
    return rated(t).select(
        "event_id", tb.timecode("tai_ns", "num", "den", F.col("event_id") % 3 == 0).alias("tc")
    )


@query(
    "audio_cadence",
    f"""with {RATED}, u as (select event_id, (cast(event_id as hugeint)*48000*den+num//2)//num a,
        ((cast(event_id as hugeint)+1)*48000*den+num//2)//num b from rated)
    select event_id, cast(a as bigint) samples_before, cast(b-a as bigint) samples from u""",
    "frames",
)
def _(t):
    return rated(t).select(
        "event_id",
        tb.samples_until("event_id", "num", "den").alias("samples_before"),
        tb.samples_for_frame("event_id", "num", "den").alias("samples"),
    )


RATE_TEXT = """case event_id % 8 when 0 then '2398' when 1 then '29.97' when 2 then '5994'
    when 3 then concat(event_id, '/1001') when 4 then '50' when 5 then '' when 6 then concat('x', event_id)
    else concat(event_id % 120) end"""


@query(
    "rate_token",
    f"""with texts as (select event_id, {RATE_TEXT} txt from events),
    p as (select event_id, txt, case when txt in ('2398','23.98') then 24000 when txt in ('2997','29.97') then 30000
        when txt in ('5994','59.94') then 60000 else try_cast(regexp_extract(split_part(txt,'/',1),'^\\s*([+-]?\\d+)',1) as int) end num,
        case when txt in ('2398','23.98','2997','29.97','5994','59.94') then 1001
        when contains(txt,'/') then try_cast(split_part(txt,'/',2) as int) else 1 end den from texts)
    select event_id, txt, case when num>0 and den>0 then num end num, case when num>0 and den>0 then den end den from p""",
)
def _(t):
    rate = tb.rate_token("txt")
    return t.events.selectExpr("event_id", f"{RATE_TEXT} txt").select(
        "event_id", "txt", rate["num"].alias("num"), rate["den"].alias("den")
    )


FORMAT_TEXT = """concat(case event_id % 6 when 0 then '1080' when 1 then '720' when 2 then '2160' when 3 then '1920x1080'
    when 4 then concat(event_id % 5000, 'x', event_id % 999) else '576' end,
    case when event_id % 7 < 3 then 'p' when event_id % 7 < 6 then 'I' else '' end,
    case event_id % 5 when 0 then '25' when 1 then '50' when 2 then '2997' when 3 then '25tff' else '25bff' end)"""


@query(
    "format_token",
    f"""with texts as (select event_id, {FORMAT_TEXT} txt from events),
    p as (select *, lower(txt) low, case when contains(lower(txt),'p') then 'p' when contains(lower(txt),'i') then 'i' else '' end m from texts),
    q as (select *, case when m<>'' then split_part(low,m,1) else '' end raster, case when m<>'' then split_part(low,m,2) else '' end rest from p),
    r as (select *, case when m='i' then replace(rest,'tff','') else rest end rt,
        case raster when '720' then 1280 when '1080' then 1920 when '2160' then 3840 else try_cast(split_part(raster,'x',1) as int) end w,
        case raster when '720' then 720 when '1080' then 1080 when '2160' then 2160 else try_cast(split_part(raster,'x',2) as int) end h from q),
    s as (select *, case when rt='2997' then 30000 else try_cast(regexp_extract(rt,'^(\\d+)',1) as int) end n,
        case when rt='2997' then 1001 else 1 end d from r),
    e as (select *, case when m='' then 'no_mode' when m='i' and low like '%bff' then 'bff'
        when raster not in ('720','1080','2160') and not contains(raster,'x') then 'raster'
        when w is null or h is null or n is null or n<=0 or w<2 or h<2 or w%2<>0 then 'format'
        when m='i' and not (w=1920 and h=1080 and ((n=25 and d=1) or (n=30000 and d=1001))) then 'interlaced' end err from s)
    select event_id, txt, case when err is null then w end width, case when err is null then h end height,
        case when err is null then m='i' end interlaced, case when err is null then n end num,
        case when err is null then d end den, err error from e""",
)
def _(t):
    return tb.parse_formats(t.events.selectExpr("event_id", f"{FORMAT_TEXT} txt"), "txt")


# Camera dimension of the fixtures: native rate (0 = unknown) and phases; camera 4 is not configured.
CAMERAS = "(1, 0, 1), (2, 150, 3), (3, 0, 3)"


@query(
    "hfr_factor",
    f"""with cams as (select * from (values {CAMERAS}) c(camera, native_fps, phases))
    select f.event_id, f.camera, cast(coalesce(case when c.native_fps>0 then c.native_fps/50.0 else greatest(1,c.phases) end, 1) as double) factor
    from frames f left join cams c using (camera)""",
    "frames",
)
def _(t):
    cameras = t.spark.sql(f"select * from values {CAMERAS} as c(camera, native_fps, phases)")
    return camera_factor(t.frames.select("event_id", "camera"), cameras, 50, 1).select("event_id", "camera", "factor")


@query(
    "id_serial",
    """with ids as (select id from clips union all select 'group-'||(cast(regexp_extract(id,'(\\d+)$',1) as bigint)//3) from clips
        union all select distinct playlist from entries union all select 'audio-'||vec_id from embeddings)
    select split_part(id,'-',1) kind, max(cast(regexp_extract(id,'-(\\d+)$',1) as bigint))+1 next_serial from ids group by 1
    union all select 'all', max(cast(regexp_extract(id,'-(\\d+)$',1) as bigint))+1 from ids""",
    "clips entries",
)
def _(t):
    groups = t.clips.select(F.concat(F.lit("group-"), F.expr("cast(regexp_extract(id, '([0-9]+)$', 1) as bigint) div 3")).alias("id"))
    audio = t.base("embeddings").select(F.concat(F.lit("audio-"), "vec_id").alias("id"))
    playlists = t.base("conversations").select(F.concat(F.lit("playlist-"), "conv_id").alias("id"))
    ids = t.clips.select("id").unionByName(groups).unionByName(audio).unionByName(playlists)
    return next_serial(ids)


@query(
    "uuid_v5",
    """with names as (select event_id, 'studio/in/'||(user_id%4+1)||'/video/'||event_id nm from events),
    h as (select event_id, nm, sha1(cast(unhex('6ba7b8119dad11d180b400c04fd430c8') as blob)||encode(nm)) x from names)
    select event_id, substr(x,1,8)||'-'||substr(x,9,4)||'-5'||substr(x,14,3)||'-'||
        case when substr(x,17,1) in ('0','4','8','c') then '8' when substr(x,17,1) in ('1','5','9','d') then '9'
        when substr(x,17,1) in ('2','6','a','e') then 'a' else 'b' end||substr(x,18,3)||'-'||substr(x,21,12) uuid from h""",
)
def _(t):
    named = t.events.select("event_id", ident.video_receiver(F.lit("studio"), F.col("user_id") % 4 + 1, F.col("event_id")).alias("nm"))
    return named.select("event_id", ident.uuid_v5("nm").alias("uuid"))


# All resources of an input and a channel, by the pattern of their names.
NAMED = {
    "node": "", "device": "", "domain": "", "video_receiver": "camera event_id", "audio_receiver": "camera", "video_source": "channel",
    "video_sender": "channel", "video_flow": "channel token", "audio_source": "channel", "audio_sender": "channel", "audio_flow": "channel",
    "data_source": "channel", "data_sender": "channel", "data_flow": "channel token",
}


@query(
    "resource_ids",
    """with e as (select event_id, user_id%4+1 camera, user_id%3+1 channel, case when event_id%2=0 then '1080p50' else '1080i25' end token from events),
    n as (select event_id, unnest([{r: 'node', nm: 'node'}, {r: 'device', nm: 'device'}, {r: 'domain', nm: 'domain'}, {r: 'video_receiver', nm: 'in/'||camera||'/video/'||event_id},
        {r: 'audio_receiver', nm: 'in/'||camera||'/audio'}, {r: 'video_source', nm: 'out/'||channel||'/video/source'}, {r: 'video_sender', nm: 'out/'||channel||'/video/sender'},
        {r: 'video_flow', nm: 'out/'||channel||'/video/flow/'||token}, {r: 'audio_source', nm: 'out/'||channel||'/audio/source'}, {r: 'audio_sender', nm: 'out/'||channel||'/audio/sender'},
        {r: 'audio_flow', nm: 'out/'||channel||'/audio/flow'}, {r: 'data_source', nm: 'out/'||channel||'/data/source'}, {r: 'data_sender', nm: 'out/'||channel||'/data/sender'},
        {r: 'data_flow', nm: 'out/'||channel||'/data/flow/'||token}]) p from e),
    h as (select event_id, p.r resource, sha1(cast(unhex('6ba7b8119dad11d180b400c04fd430c8') as blob)||encode('studio/seed-'||(event_id%5)||'/'||p.nm)) x from n)
    select event_id, resource, substr(x,1,8)||'-'||substr(x,9,4)||'-5'||substr(x,14,3)||'-'||substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(x,17,1)), 1)||substr(x,18,3)||'-'||substr(x,21,12) uuid from h""",
)
def _(t):
    rows = t.events.selectExpr(
        "event_id", "user_id % 4 + 1 camera", "user_id % 3 + 1 channel", "case when event_id % 2 = 0 then '1080p50' else '1080i25' end token",
        "concat('seed-', event_id % 5) seed",
    )
    names = ident.resources({k: tuple(v.split()) for k, v in NAMED.items()}, F.lit("studio"), F.col("seed"))
    return rows.select("event_id", F.inline(names)).select("event_id", "resource", ident.uuid_v5("name").alias("uuid"))


ENUM_TEXT = """case event_id % 9 when 0 then 'repeat' when 1 then 'blend' when 2 then 'interpolate' when 3 then 'stretch'
    when 4 then 'follow' when 5 then 'live' when 6 then 'loop' when 7 then 'mix' else 'nothing' end"""


@query(
    "enum_normalise",
    f"""with texts as (select event_id, {ENUM_TEXT} txt from events)
    select event_id, case when txt in ('repeat','blend','interpolate') then txt else 'interpolate' end motion,
        txt in ('repeat','blend','interpolate') motion_ok,
        case when txt in ('mute','stretch','follow') then txt else 'mute' end audio, txt in ('mute','stretch','follow') audio_ok,
        case when txt='live' then 'return-to-live' when txt in ('freeze','black','loop','next','return-to-live') then txt else 'freeze' end end_action,
        txt in ('freeze','black','loop','next','return-to-live','live') end_ok,
        case when txt='mix' then 'mix' else 'cut' end transition, txt in ('cut','mix') transition_ok from texts""",
)
def _(t):
    texts = t.events.selectExpr("event_id", f"{ENUM_TEXT} txt")
    columns = [F.col("event_id")]
    for kind, label in (("motion", "motion"), ("audio", "audio"), ("end_action", "end"), ("transition", "transition")):
        pair = ident.normalise(kind, "txt")
        columns += [pair["value"].alias(kind), pair["ok"].alias(f"{label}_ok")]
    return texts.select(*columns)


@query("flow_key", "select probe, camera||':'||at_ns||':'||(at_ns+20000000) flow from probes", "probes")
def _(t):
    return t.probes.select("probe", ident.flow_key("camera", "at_ns", F.col("at_ns") + 20000000).alias("flow"))


@query(
    "db_to_gain",
    "select event_id, round(case when value/2-125<=-120 then 0 else pow(10,(value/2-125)/20) end,6) gain from events",
)
def _(t):
    return t.events.select("event_id", F.round(ident.db_to_gain(F.col("value") / 2 - 125), 6).alias("gain"))


@query(
    "frame_bytes_estimate",
    """select event_id, round((640+event_id%3200)*cast(360 as double)*0.1875*(case when event_id%101<=0 then 1 else (event_id%101)/92.0 end),3) frame_bytes,
        round((640+event_id%3200)*cast(360 as double)*0.1875*(case when event_id%101<=0 then 1 else (event_id%101)/92.0 end)*50*3600,0) hour_bytes from events""",
)
def _(t):
    size = (F.col("event_id") % 3200 + 640, F.lit(360), F.col("event_id") % 101)
    return t.events.select(
        "event_id",
        F.round(tb.frame_bytes(*size), 3).alias("frame_bytes"),
        F.round(tb.bytes_per_hour(*size, 50), 0).alias("hour_bytes"),
    )


@query(
    "stretch_length",
    """select event_id, cast(greatest(1, round(event_id/greatest(event_id%200/100.0, 0.0001))) as bigint) samples from events""",
)
def _(t):
    return t.events.select("event_id", tb.stretch_length("event_id", F.col("event_id") % 200 / 100).alias("samples"))
