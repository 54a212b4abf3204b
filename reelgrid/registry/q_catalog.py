"""Catalogue scans, edits, searches and rules."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from reelgrid.functions import playout as pf
from reelgrid.functions.timebase import timecode
from reelgrid.operators import catalog, documents, edits
from reelgrid.registry import query

CAMERAS = "(1, 'Main', 'red'), (2, 'Goal left', 'green'), (3, 'Goal right', 'blue'), (4, 'Beauty', 'grey')"


def cameras(t):
    return t.spark.sql(f"select * from values {CAMERAS} as c(camera, label, colour)")


@query(
    "catalog_scan",
    """select playlist, count(*) n, string_agg(position||':'||clip_id, ',' order by position) entries from entries group by 1""",
    "entries",
)
def _(t):
    lists = catalog.playlist_documents(t.entries, ["clip_id"])
    line = F.array_join(F.transform("entries", lambda e: F.concat_ws(":", e["position"], e["clip_id"])), ",")
    return lists.select("playlist", F.size("entries").cast("long").alias("n"), line.alias("entries"))


CHANGES = """select 'clip-'||(event_id//2*2) id, 'renamed '||event_id as name, cast(1 as int) camera, event_id seq from events where event_type='purchase'"""


@query(
    "catalog_upsert",
    f"""with ch as ({CHANGES}), l as (select * from ch qualify row_number() over (partition by id order by seq desc)=1),
    ne as (select playlist, position*2 as position, 'clip-'||position clip_id from entries where auto_advance and transition='mix'),
    rn as (select playlist, row_number() over (partition by playlist order by position)-1 as position, clip_id from ne)
    select 'clip' kind, id, cast(null as bigint) as position, name payload from (select id, name from clips where id not in (select id from l) union all select id, name from l)
    union all select 'entry', playlist, position, clip_id from (select playlist, position, clip_id from entries where playlist not in (select playlist from rn) union all select * from rn)""",
    "clips entries",
)
def _(t):
    changes = t.events.filter("event_type = 'purchase'").selectExpr(
        "concat('clip-', event_id div 2 * 2) id", "concat('renamed ', event_id) name", "1 camera", "event_id seq"
    )
    clips = catalog.upsert(t.clips.select("id", "name", "camera"), changes, "id", "seq")
    edited = t.entries.filter("auto_advance and transition = 'mix'").selectExpr(
        "playlist", "position * 2 position", "concat('clip-', position) clip_id"
    )
    entries = catalog.replace_entries(t.entries.select("playlist", "position", "clip_id"), edits.renumbered(edited))
    return clips.selectExpr("'clip' kind", "id", "cast(null as bigint) position", "name payload").unionByName(
        entries.selectExpr("'entry' kind", "playlist id", "position", "clip_id payload")
    )


@query(
    "catalog_delete",
    """with d as (select 'playlist-'||conv_id playlist from conversations where turn=0 and conv_id%3=1)
    select playlist, position, clip_id from entries where playlist not in (select playlist from d)""",
    "entries",
)
def _(t):
    doomed = t.base("conversations").filter("turn = 0 and conv_id % 3 = 1").selectExpr("concat('playlist-', conv_id) playlist")
    return catalog.delete(t.entries.select("playlist", "position", "clip_id"), doomed, "playlist")


@query(
    "catalog_evolve",
    "select id, camera, cast(1.0 as double) speed, 'interpolate' motion, '' tags, name from clips",
    "clips",
)
def _(t):
    old = t.clips.select("id", "name", "camera")
    target = StructType(
        [
            StructField("id", StringType()),
            StructField("camera", IntegerType()),
            StructField("speed", DoubleType()),
            StructField("motion", StringType()),
            StructField("tags", StringType()),
        ]
    )
    once = catalog.evolve(old, target, {"speed": 1.0, "motion": "interpolate", "tags": ""})
    return catalog.evolve(once, target, {"speed": 9.0})


@query(
    "catalog_export",
    """select id, '{"id":"'||id||'","name":"'||name||'","camera":'||camera||',"in_ns":'||in_ns||',"out_ns":'||out_ns||',"speed":'||speed||',"tags":"'||tags||'","end":"'||end_action||'","library":'||library||'}' as document from clips
    union all select playlist, '{"id":"'||playlist||'","entries":['||string_agg('{"clip_id":"'||clip_id||'","speed":'||speed||',"end":"'||end_action||'","auto_advance":'||auto_advance||',"transition":"'||transition
        ||'","transition_frames":'||transition_frames||',"audio_frames":'||audio_frames||',"own_audio":'||own_audio||'}', ',' order by position)||']}' from entries group by 1""",
    "clips entries",
)
def _(t):
    return documents.export_clips(t.clips).unionByName(documents.export_playlists(t.entries))


# Lists with a name, a loop flag and a bed; every fifth bed has a level out of range, which an import puts back to all
# defaults. Clips and entries have all their fields; a cut has no frames and a mix without frames has the default.
LISTS = """lists as (select playlist, cast(split_part(playlist,'-',2) as bigint) n from entries group by 1)"""
LIST_TEXT = """'{"id":"'||playlist||'","name":"List '||n||'","loop":'||(n%3=0)||',"entries":['||e||'],"aux":'||aux||'}'"""
BED = """'{"source":"clip-'||n||'","level_db":'||cast(LEVEL as double)||',"loop":'||(n%2=0)||',"fade_out_frames":'||(n%7*10)||',"duck_db":-12.0,"attack_ms":'||(n%9*100)||',"release_ms":400}'"""


@query(
    "catalog_round_trip",
    f"""with {LISTS}, e as (select playlist, string_agg('{{"clip_id":"'||clip_id||'","speed":'||speed||',"end":"'||end_action||'","auto_advance":'||auto_advance||',"transition":"'||transition
        ||'","transition_frames":'||case when transition='mix' then case when transition_frames=0 then 25 else transition_frames end else 0 end||',"audio_frames":'||audio_frames||',"own_audio":'||own_audio||'}}', ',' order by position) e from entries group by 1),
    a as (select *, case when n%5=0 then '{{"source":"","level_db":0.0,"loop":true,"fade_out_frames":50,"duck_db":-12.0,"attack_ms":200,"release_ms":500}}' else {BED.replace('LEVEL', 'n%60-50')} end aux from lists)
    select 'playlist' kind, playlist id, {LIST_TEXT} as document from a join e using (playlist)
    union all select 'clip', id, '{{"id":"'||id||'","name":"'||name||'","camera":'||camera||',"in_ns":'||in_ns||',"out_ns":'||out_ns||',"speed":'||speed||',"motion":"blend","audio":"mute","colour":"c'||camera||'","tags":"'||tags||'","end":"'||end_action||'","library":'||library||',"group":"g'||camera||'"}}' from clips
    union all select 'setting', 'CH'||camera||'_LABEL', '{{"key":"CH'||camera||'_LABEL","value":"'||count(*)||'"}}' from clips group by camera""",
    "clips entries",
)
def _(t):
    number = F.expr("cast(split(playlist, '-')[1] as bigint)")
    level = F.when(F.col("n") % 5 == 0, F.lit(99.0)).otherwise(F.expr("cast(n % 60 - 50 as double)"))
    bed = F.struct(
        F.concat(F.lit("clip-"), "n").alias("source"), level.alias("level_db"), (F.col("n") % 2 == 0).alias("loop"),
        F.expr("cast(n % 7 * 10 as int) fade_out_frames"), F.lit(-12.0).alias("duck_db"), F.expr("cast(n % 9 * 100 as int) attack_ms"), F.lit(400).alias("release_ms"),
    )
    lists = t.entries.select("playlist").distinct().withColumn("n", number).select(
        F.col("playlist").alias("id"), F.concat(F.lit("List "), "n").alias("name"), (F.col("n") % 3 == 0).alias("loop"), bed.alias("aux")
    )
    clips = t.clips.selectExpr(
        "id", "name", "camera", "in_ns", "out_ns", "speed", "tags", "library", "end_action", "'blend' motion", "'mute' audio", "concat('c', camera) colour",
        "concat('g', camera) group",
    )
    settings = t.clips.groupBy("camera").agg(F.count("*").cast("string").alias("value")).select(F.expr("concat('CH', camera, '_LABEL') key"), "value")

    def written(settings, clips, lists, entries):
        parts = {"setting": documents.export_settings(settings), "clip": documents.export_clips(clips), "playlist": documents.export_playlists(entries, lists)}
        return {kind: part.withColumn("kind", F.lit(kind)) for kind, part in parts.items()}

    first = written(settings, clips, lists, t.entries)
    again = written(
        documents.import_settings(first["setting"]), documents.import_clips(first["clip"].select("document")),
        documents.import_playlists(first["playlist"]), documents.import_entries(first["playlist"]),
    )
    return again["setting"].unionByName(again["clip"]).unionByName(again["playlist"])


DOC = """'{"id":"'||case when event_id%13=0 then '' else 'clip-'||event_id end||'","name":"n'||event_id||'","camera":'||(user_id%4+1)||',"in_ns":'||(event_id*1000000000)||
    case when event_id%3=0 then '' else ',"out_ns":'||(event_id*1000000000+5000000000) end||case when event_id%4=0 then '' else ',"speed":0.5' end||',"end":"'||event_type||'"'||
    case when event_id%5=0 then ',"library":true' else '' end||'}'"""


@query(
    "catalog_import",
    """with i as (select 'clip-'||event_id id, cast(user_id%4+1 as int) camera, event_id*1000000000 in_ns,
        case when event_id%3=0 then event_id*1000000000 else event_id*1000000000+5000000000 end out_ns,
        cast(case when event_id%4=0 then 1.0 else 0.5 end as double) speed, 'freeze' end_action, event_id%5=0 library from events where event_id%13<>0)
    select 'clip' kind, id, camera, in_ns, out_ns, speed, end_action from i
    union all select 'protect', id, camera, in_ns, out_ns, null, null from i where not library
    union all select 'release', id, camera, in_ns, out_ns, null, null from clips where not library and id in (select id from i)""",
    "clips",
)
def _(t):
    text = F.concat(
        F.lit('{"id":"'), F.when(F.col("event_id") % 13 == 0, "").otherwise(F.concat(F.lit("clip-"), "event_id")),
        F.lit('","name":"n'), "event_id", F.lit('","camera":'), F.col("user_id") % 4 + 1, F.lit(',"in_ns":'), F.col("event_id") * 1_000_000_000,
        F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit(',"out_ns":'), F.col("event_id") * 1_000_000_000 + 5_000_000_000)),
        F.when(F.col("event_id") % 4 == 0, "").otherwise(',"speed":0.5'), F.lit(',"end":"'), "event_type", F.lit('"'),
        F.when(F.col("event_id") % 5 == 0, ',"library":true').otherwise(""), F.lit("}"),
    )
    imported = documents.import_clips(t.events.select(text.alias("document")))
    clips = imported.select(F.lit("clip").alias("kind"), "id", "camera", "in_ns", "out_ns", "speed", "end_action")
    ranges = documents.range_changes(t.clips, imported).withColumnRenamed("change", "kind")
    return clips.unionByName(ranges, allowMissingColumns=True)


@query(
    "clip_search",
    f"""with c as (select * from (values {CAMERAS}) v(camera, label, colour)),
    x as (select id, lower(name||' '||id||' '||tags||' '||label||' '||strftime(make_timestamp(in_ns//1000), '%H:%M:%S')||':'||
        lpad(cast(cast(((in_ns+10000000)//20000000-(in_ns//1000000000)*50)%50 as int) as varchar),2,'0')) txt from clips join c using (camera) where not library)
    select id, cast(regexp_extract(id,'(\\d+)$',1) as bigint) serial from x where contains(txt,'goal') and contains(txt,'k1')""",
    "clips",
)
def _(t):
    timed = t.clips.withColumn("timecode", timecode("in_ns", 50, 1))
    found = catalog.search(timed, F.lit(" GOAL  k1 "), cameras(t), "buffer")
    return found.select("id", catalog.serial("id").alias("serial")).orderBy(F.desc("serial"))


@query(
    "tag_explode",
    "select tag, count(*) clips from (select trim(unnest(string_split(tags, ','))) tag from clips) where tag<>'' group by 1",
    "clips",
)
def _(t):
    return t.clips.select(F.explode(catalog.tags_of("tags")).alias("tag")).groupBy("tag").agg(F.count("*").alias("clips"))


@query(
    "clip_play_time",
    "select id, cast(trunc((out_ns-in_ns)/case when abs(speed-0.25)<1e-3 then 1.0 else abs(speed-0.25) end) as bigint) play_ns from clips",
    "clips",
)
def _(t):
    return t.clips.select("id", pf.play_time("in_ns", "out_ns", F.col("speed") - 0.25).alias("play_ns"))


@query(
    "shot_list",
    """with d as (select playlist, cast(coalesce(sum(case when present then trunc((out_ns-in_ns)/speed) end),0) as bigint) dur from listed group by 1)
    select id, 'clip' kind, name, cast(trunc((out_ns-in_ns)/speed) as bigint) play_ns, cast(regexp_extract(id,'(\\d+)$',1) as bigint) serial from clips
    union all select playlist, 'playlist', 'list '||playlist, dur, cast(regexp_extract(playlist,'(\\d+)$',1) as bigint) from d""",
    "listed",
)
def _(t):
    length = F.when(F.col("present"), pf.play_time("in_ns", "out_ns", "speed"))
    lists = t.listed.groupBy("playlist").agg(F.coalesce(F.sum(length), F.lit(0)).alias("duration_ns"))
    named = lists.withColumn("name", F.concat(F.lit("list "), "playlist"))
    return catalog.shots(t.clips, named).orderBy("serial", "id")


@query(
    "playlist_stack",
    """with f as (select playlist, clip_id, min(position) as position from entries where clip_id in (select id from clips) group by 1,2)
    select playlist, clip_id, position, cast(row_number() over (partition by playlist order by position) as int) place from f
    qualify row_number() over (partition by playlist order by position)<=3""",
    "entries clips",
)
def _(t):
    return catalog.first_clips(t.entries, t.clips, 3)


@query(
    "timeline_view",
    """with b as (select camera, min(tai_ns) oldest, max(tai_ns) last_ns from frames group by 1),
    v as (select user_id, camera, max(at_ns) pos from (select user_id, cast(user_id%4+1 as int) camera, epoch_us(ts)*1000 at_ns from events) group by all),
    r as (select user_id, camera, pos, last_ns, greatest(oldest, last_ns-24*3600*cast(1000000000 as bigint)) first_ns from v join b using (camera)),
    s as (select *, greatest(first_ns, last_ns-7200*cast(1000000000 as bigint)) st from r),
    w as (select user_id, camera, case when pos<st then greatest(first_ns, pos-1800*cast(1000000000 as bigint)) else st end start_ns,
        case when pos<st then greatest(first_ns, pos-1800*cast(1000000000 as bigint))+7200*cast(1000000000 as bigint) else last_ns end end_ns from s),
    z as (select user_id, camera, start_ns, greatest(end_ns, start_ns+1000000000) end_ns from w)
    select z.user_id, z.camera, start_ns, end_ns, c.id, round(least(100, greatest(0, (c.in_ns-start_ns)*cast(100 as double)/(end_ns-start_ns))),6) left_pct,
        round(greatest(0.25, least(100, greatest(0, (c.out_ns-start_ns)*cast(100 as double)/(end_ns-start_ns)))-least(100, greatest(0, (c.in_ns-start_ns)*cast(100 as double)/(end_ns-start_ns)))),6) width_pct
    from z join clips c on c.camera=z.camera and c.out_ns>=start_ns and c.in_ns<=end_ns""",
    "frames clips",
)
def _(t):
    bounds = t.frames.groupBy("camera").agg(F.min("tai_ns").alias("oldest_ns"), F.max("tai_ns").alias("newest_ns"))
    latest = t.events.selectExpr("user_id", "cast(user_id % 4 + 1 as int) camera", "unix_micros(cast(ts as timestamp)) * 1000 at_ns")
    views = latest.groupBy("user_id", "camera").agg(F.max("at_ns").alias("position_ns"))
    return edits.timeline_view(views, bounds, t.clips, ["user_id"], 24, 7200).withColumns(
        {"left_pct": F.round("left_pct", 6), "width_pct": F.round("width_pct", 6)}
    )


@query(
    "clip_create",
    f"""with c as (select * from (values {CAMERAS}) v(camera, label, colour)),
    r as (select event_id request, cast(user_id%4+1 as int) camera, epoch_us(ts)*1000 in_ns, epoch_us(ts)*1000+(event_id%7-1)*1000000000 out_ns,
        value%4-1 target_speed, event_id%3=0 all_angles, event_id%2=0 force, event_id%5=0 over_cap, case when event_id%4=0 then '' else 'goal' end nm from events where event_type='click'),
    e as (select *, case when out_ns<=in_ns then 'marks:order' when not force and over_cap then 'cap:exceeded' end error from r),
    m as (select *, sum(made) over (order by request)-made b from (select *, case when error is not null then 0 when all_angles then 4 else 1 end made from e)),
    o as (select m.*, c.camera cc, c.label, c.colour, case when all_angles then c.camera-1 else 0 end nth from m join c on error is null and (all_angles or c.camera=m.camera))
    select request, error, 'clip-'||(b+nth+5000) id, case when nm='' then 'clip-'||(b+nth+5000) else nm end||case when all_angles then ' '||label else '' end as name, cc camera, in_ns, out_ns,
        case when target_speed between 0.01 and 2 then target_speed else 1 end speed, colour, case when all_angles then 'group-'||(b+5000) end group_id from o
    union all select request, error, null, null, null, null, null, null, null, null from e where error is not null""",
)
def _(t):
    requests = t.events.filter("event_type = 'click'").selectExpr(
        "event_id request", "cast(user_id % 4 + 1 as int) camera", "unix_micros(cast(ts as timestamp)) * 1000 in_ns",
        "unix_micros(cast(ts as timestamp)) * 1000 + (event_id % 7 - 1) * 1000000000 out_ns", "value % 4 - 1 target_speed",
        "event_id % 3 = 0 all_angles", "event_id % 2 = 0 force", "event_id % 5 = 0 over_cap", "case when event_id % 4 = 0 then '' else 'goal' end name",
    )
    return catalog.create_clips(requests, cameras(t), 5000)


EDITS = """select id, camera, case when cast(regexp_extract(id,'(\\d+)$',1) as bigint)%3=0 then in_ns+15000000 else in_ns end in_ns,
    case cast(regexp_extract(id,'(\\d+)$',1) as bigint)%5 when 0 then out_ns+600000000000 when 1 then in_ns-300000000000 else out_ns end out_ns,
    case when cast(regexp_extract(id,'(\\d+)$',1) as bigint)%4=0 then '' else 'edit' end as name, cast(regexp_extract(id,'(\\d+)$',1) as bigint)%2=0 force from {c}"""


@query(
    "clip_update",
    f"""with ed as ({EDITS.format(c='clips')} union all select 'clip-none', 1, 1, 2, 'x', true),
    k as (select ed.*, c.id is not null known, c.in_ns oi, c.out_ns oo, c.library lib, c.name oname, c.camera oc from ed left join clips c using (id)),
    a1 as (select k.*, f.tai_ns b1 from k asof left join frames f on f.camera=k.camera and k.in_ns>=f.tai_ns),
    a2 as (select a1.*, f.tai_ns n1 from a1 asof left join frames f on f.camera=a1.camera and a1.in_ns<f.tai_ns),
    a3 as (select a2.*, f.tai_ns b2 from a2 asof left join frames f on f.camera=a2.camera and a2.out_ns>=f.tai_ns),
    a4 as (select a3.*, f.tai_ns n2 from a3 asof left join frames f on f.camera=a3.camera and a3.out_ns<f.tai_ns),
    s as (select *, case when b1 is null or n1-in_ns<in_ns-b1 then coalesce(n1,b1) else b1 end s1, case when b2 is null or n2-out_ns<out_ns-b2 then coalesce(n2,b2) else b2 end s2 from a4),
    z as (select *, in_ns<>oi mi, out_ns<>oo mo, case when in_ns<>oi then case when abs(s1-in_ns)<=300000000000 then s1 end else in_ns end ni,
        case when out_ns<>oo then case when abs(s2-out_ns)<=300000000000 then s2 end else out_ns end no from s),
    r as (select *, case when not known then 'unknown' when (mi or mo) and (ni is null or no is null) then 'no_frame' when (mi or mo) and no<ni then 'out_before_in'
        when (mi or mo) and (ni<oi or no>oo) and not lib and not force then 'over_cap' else 'ok' end result from z)
    select id, result, case when result='ok' then ni end in_ns, case when result='ok' then no end out_ns, case when result='ok' then case when name='' then oname else name end end as name,
        result='ok' and (mi or mo) and not lib range_moved from r""",
    "clips frames",
)
def _(t):
    given = t.clips.selectExpr(*[x.strip() for x in (
        "id", "camera", "case when cast(regexp_extract(id, '([0-9]+)$', 1) as bigint) % 3 = 0 then in_ns + 15000000 else in_ns end in_ns",
        "case cast(regexp_extract(id, '([0-9]+)$', 1) as bigint) % 5 when 0 then out_ns + 600000000000 when 1 then in_ns - 300000000000 else out_ns end out_ns",
        "case when cast(regexp_extract(id, '([0-9]+)$', 1) as bigint) % 4 = 0 then '' else 'edit' end name",
        "cast(regexp_extract(id, '([0-9]+)$', 1) as bigint) % 2 = 0 force",
    )])
    unknown = t.spark.sql("select 'clip-none' id, 1 camera, 1L in_ns, 2L out_ns, 'x' name, true force")
    return edits.update_clips(given.unionByName(unknown), t.clips, t.frames, 300_000_000_000, F.lit(True))


@query(
    "clip_delete",
    """with k as (select * from clips where id not in (select 'clip-'||event_id from events where event_id%5=0))
    select camera, in_ns begin_ns, out_ns end_ns, count(*) holders, null as id from k where not library group by all
    union all select camera, in_ns, out_ns, null, id from k""",
    "clips",
)
def _(t):
    doomed = t.events.filter("event_id % 5 = 0").selectExpr("concat('clip-', event_id) id")
    left, ranges = edits.delete_clips(t.clips, doomed)
    clips = left.selectExpr("camera", "in_ns begin_ns", "out_ns end_ns", "id")
    return ranges.unionByName(clips, allowMissingColumns=True)


@query(
    "clip_consolidate",
    """with w as (select 'clip-'||event_id id from events where event_id%4=0)
    select id, camera, library or id in (select id from w) library, not library and id in (select id from w) released from clips""",
    "clips",
)
def _(t):
    wanted = t.events.filter("event_id % 4 = 0").selectExpr("concat('clip-', event_id) id")
    return edits.consolidate_clips(t.clips, wanted).select("id", "camera", "library", "released")


RULED = """select event_id, case when event_id%9=0 then '' else 'clip-'||event_id end clip_id, event_id%250/100.0 speed, event_type end_action, case event_id%5 when 0 then 'cut' when 1 then 'wipe' else 'mix' end transition,
    event_id%300 transition_frames, event_id%260-3 audio_frames, value/2-60 level_db, event_id%1100 fade_out_frames, value/4-62 duck_db, event_id%5500 attack_ms, event_id%10500 release_ms from events"""


@query(
    "catalog_validate",
    f"""with r as (select * replace (case end_action when 'view' then 'freeze' when 'click' then 'live' when 'purchase' then 'next' else end_action end as end_action) from ({RULED}))
    select event_id, case when clip_id='' then 'clip_id:missing' when end_action not in ('freeze','live','next') then 'end_action:unknown'
        when transition='wipe' then 'transition:unknown' when transition_frames>250 then 'transition_frames:range'
        when audio_frames<-1 or audio_frames>250 then 'audio_frames:range' when speed<0.01 or speed>2 then 'speed:range' end entry_problem,
        case when level_db<-60 or level_db>12 then 'level_db:range' when fade_out_frames>1000 then 'fade_out_frames:range'
        when duck_db<-60 or duck_db>0 then 'duck_db:range' when attack_ms>5000 then 'attack_ms:range'
        when release_ms>10000 then 'release_ms:range' end aux_problem,
        case when event_id%7=0 then 'motion:unknown' when event_id%8=0 then 'audio:unknown' when end_action not in ('freeze','live','next') then 'end_action:unknown'
        when event_id%11=0 then 'out_ns:order' when speed<0.01 or speed>2 then 'speed:range' end clip_problem from r""",
)
def _(t):
    rows = t.events.selectExpr(
        "event_id", "case when event_id % 9 = 0 then '' else concat('clip-', event_id) end clip_id", "event_id % 250 / 100.0D speed",
        "case event_type when 'view' then 'freeze' when 'click' then 'live' when 'purchase' then 'next' else event_type end end_action",
        "case event_id % 5 when 0 then 'cut' when 1 then 'wipe' else 'mix' end transition", "event_id % 300 transition_frames",
        "event_id % 260 - 3 audio_frames", "value / 2 - 60 level_db", "event_id % 1100 fade_out_frames", "value / 4 - 62 duck_db",
        "event_id % 5500 attack_ms", "event_id % 10500 release_ms",
    )
    aux = catalog.limit_rule(["level_db", "fade_out_frames", "duck_db", "attack_ms", "release_ms"])
    clip = rows.selectExpr(
        "*", "case when event_id % 7 = 0 then 'warp' else 'blend' end c_motion", "case when event_id % 8 = 0 then 'loud' else 'follow' end c_audio",
        "end_action c_end_action", "1 c_in_ns", "event_id % 11 c_out_ns", "speed c_speed",
    )
    return clip.select(
        "event_id", catalog.entry_rule().alias("entry_problem"), aux.alias("aux_problem"), catalog.clip_rule("c_").alias("clip_problem")
    )


@query(
    "aux_patch",
    """with s as (select user_id id, max(event_id)%60-50.0 level_db, max(event_id)%100 fade from events group by 1),
    l as (select user_id id, max(event_id) e from events group by 1)
    select id, cast(case when e%2=0 then -6.0 else level_db end as double) level_db, case when e%3=0 then 25 else fade end fade_out_frames from s join l using (id)""",
)
def _(t):
    last = t.events.groupBy(F.col("user_id").alias("id")).agg(F.max("event_id").alias("e"))
    stored = last.selectExpr("id", "cast(e % 60 - 50.0 as double) level_db", "e % 100 fade_out_frames")
    changes = last.selectExpr("id", "case when e % 2 = 0 then -6.0D end level_db", "case when e % 3 = 0 then 25L end fade_out_frames")
    return catalog.patch(stored, changes, "id", ["level_db", "fade_out_frames"])


