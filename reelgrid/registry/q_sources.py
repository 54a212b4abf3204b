"""Scans, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from reelgrid.operators import joins, status
from reelgrid.operators.store import segment_assign
from reelgrid.plans.session import ensure_checkpoint_dir
from reelgrid.registry import ORACLES, query
from reelgrid.registry.q_playout import transport_states
from reelgrid.registry.q_store import HOUR, RECURSIVE
from reelgrid.sources import documents, frames, tally

FROM, TO = 1_704_500_000_000_000_000, 1_705_900_000_000_000_000


def fresh_folder(spark, name: str) -> str:
    """A new folder beside the checkpoints, which every executor can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4()}"


@query(
    "frames_scan",
    f"select camera, tai_ns, event_id, payload_bytes from frames where camera in (1,2) and tai_ns between {FROM} and {TO}",
    "frames",
)
def _(t):
    found = frames.scan_frames(t.frames, [1, 2], FROM, TO)
    return found.select("camera", "tai_ns", "event_id", "payload_bytes").orderBy("camera", "tai_ns")


@query(
    "frames_bounds",
    "select camera, min(tai_ns) oldest_ns, max(tai_ns) newest_ns, count(*) frames from frames group by 1",
    "frames",
)
def _(t):
    return frames.frame_bounds(t.frames)


@query(
    "frames_sink",
    "select camera, cast(tai_ns//86400000000000 as int) as day, count(*) frames, cast(sum(payload_bytes) as bigint) bytes, max(tai_ns) newest_ns from frames group by all",
    "frames",
)
def _(t):
    folder = fresh_folder(t.spark, "frames")
    frames.write_frames(t.frames, folder)
    stored = frames.read_frames(t.spark, folder)
    return stored.groupBy("camera", "day").agg(
        F.count("*").alias("frames"), F.sum("payload_bytes").alias("bytes"), F.max("tai_ns").alias("newest_ns")
    )


@query(
    "segment_spans",
    RECURSIVE
    + f""", z as (select camera, n.segment, tai_ns, payload_bytes+16 sz, 8+sum(payload_bytes+16) over (partition by camera, n.segment order by tai_ns) e from assigned join numbered n using (camera, first_ns))
    select camera, segment, cast(min(e-sz) as bigint) begin_byte, cast(max(e) as bigint) end_byte from z where tai_ns between {FROM} and {TO} group by all""",
    "frames clips",
)
def _(t):
    placed = segment_assign(t.frames, HOUR, ["payload_bytes"])
    return frames.segment_spans(placed.select("camera", "segment", "tai_ns", "payload_bytes"), FROM, TO)


@query(
    "clip_extract",
    """with p as (select id, camera, cast(n as int) n, in_ns+n*cast(600000000000 as bigint) at_ns from clips, range(4) r(n) where in_ns+n*cast(600000000000 as bigint)<=out_ns),
    b as (select p.*, f.tai_ns bt, f.event_id be from p asof left join frames f on f.camera=p.camera and p.at_ns>=f.tai_ns),
    x as (select b.*, f.tai_ns nt, f.event_id ne from b asof left join frames f on f.camera=b.camera and b.at_ns<f.tai_ns)
    select id, camera, n, at_ns, case when bt is null or nt-at_ns<at_ns-bt then coalesce(nt,bt) else bt end tai_ns,
        case when bt is null or nt-at_ns<at_ns-bt then coalesce(ne,be) else be end event_id from x""",
    "clips frames",
)
def _(t):
    return frames.clip_extract(t.clips, t.frames, 600_000_000_000, ["event_id"])


@query(
    "registry_scan",
    """select 'domain='||lang||'-'||source folder, case when source like '%1%' then 'd-'||lang||'-'||source else '' end id, count(*)||' documents' as label, count(*)%2=0 mirror
    from documents group by lang, source having id<>''""",
)
def _(t):
    root = fresh_folder(t.spark, "domains")
    groups = t.base("documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    definition = F.struct(
        F.when(F.contains("source", F.lit("1")), F.concat_ws("-", F.lit("d"), "lang", "source")).otherwise("").alias("id"),
        F.concat("n", F.lit(" documents")).alias("label"),
        (F.col("n") % 2 == 0).alias("mirror"),
    )
    rows = groups.select(F.concat_ws("-", "lang", "source").alias("domain"), F.to_json(definition).alias("value"))
    rows.write.partitionBy("domain").text(root)
    return documents.scan_registry(t.spark, root, "part-*")


FLOW_DEF = """case event_id % 9 when 0 then 'not json' else concat('{',
    case event_id % 4 when 0 then '' when 1 then '"interlace_mode":"progressive",' when 2 then '"interlace_mode":"interlaced_tff",' else '"interlace_mode":"interlaced_bff",' end,
    case event_id % 5 when 0 then '' when 1 then '"grain_rate":{"numerator":25,"denominator":1},' when 2 then '"grain_rate":{"numerator":50,"denominator":2},' when 3 then '"grain_rate":{"numerator":25},' else '"grain_rate":{"numerator":30000,"denominator":1001},' end,
    case event_id % 7 when 0 then '"frame_width":1280,"frame_height":720' when 1 then '"frame_width":1920,"frame_height":1080' else '"x":1' end, '}') end"""


@query(
    "flow_compat",
    f"""with d as (select event_id, {FLOW_DEF} j from events), p as (select event_id, case when json_valid(j) then j else '{{}}' end j from d),
    f as (select event_id, json_extract_string(j,'$.interlace_mode') m, cast(json_extract_string(j,'$.grain_rate.numerator') as bigint) n,
        coalesce(cast(json_extract_string(j,'$.grain_rate.denominator') as bigint),1) dn, cast(json_extract_string(j,'$.frame_width') as bigint) w from p),
    c as (select *, m is null or m='progressive' pr from f),
    r as (select *, case when not pr and m='interlaced_bff' then 'interlaced_bff' when n is not null and n<>dn*25 then case when pr then 'rate' else 'interlaced_rate' end
        when n is null and not pr then 'interlaced_rate' when w<>1920 then 'raster' end reason from c)
    select event_id, reason, reason is null and not pr woven, case when not pr then 'interlaced' end progressive_house from r""",
)
def _(t):
    definition = F.expr(FLOW_DEF)
    return documents.with_flow(t.events, definition).select(
        "event_id",
        documents.flow_compat(1920, 1080, 25, 1, True).alias("i"),
        documents.flow_compat(1920, 1080, 50, 1, False).alias("p"),
    ).select("event_id", "i.reason", "i.woven", F.col("p.reason").alias("progressive_house"))


@query(
    "log_ingest",
    """select event_id, case when event_id%10=0 then null else case when event_type='error' then 'warn' else 'info' end end as level, event_type as event,
        'camera='||(user_id%4+1)||',value='||event_id as fields from events where event_id%11<>0""",
)
def _(t):
    level = F.when(F.col("event_id") % 10 != 0, F.concat(F.lit('"level":"'), F.when(F.col("event_type") == "error", "warn").otherwise("info"), F.lit('",')))
    line = F.concat(
        F.lit("{"), F.coalesce(level, F.lit("")), F.lit('"event":"'), "event_type", F.lit('","value":"'), "event_id",
        F.lit('","camera":"'), F.col("user_id") % 4 + 1, F.lit('"}'),
    )
    lines = t.events.select("event_id", F.when(F.col("event_id") % 11 == 0, "plain text").otherwise(line).alias("value"))
    parsed = documents.parse_log(lines)
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return parsed.select("event_id", "level", "event", pairs.alias("fields"))


def le16(column):
    text = F.lpad(F.hex(column), 4, "0")
    return F.concat(F.substring(text, 3, 2), F.substring(text, 1, 2))


def packed(t):
    """Tally rows packed into packets: one display each, some damaged, some behind a control record."""
    wide = F.col("event_id") % 2 == 1
    label = F.concat(F.lit("CAM "), F.col("display") + 1)
    body = F.when(wide, F.hex(F.encode(label, "UTF-16LE"))).otherwise(F.hex(label.cast("binary")))
    size = F.when(wide, F.length(label) * 2).otherwise(F.length(label))
    control = F.col("rh") + F.col("txt") * 4 + F.col("lh") * 16 + F.lit(192)
    special = F.when(F.col("event_id") % 5 == 0, F.lit("0700008003" + "00" + "010203")).otherwise("")
    inner = F.concat(
        F.lit("00"), F.when(wide, "01").otherwise("00"), le16(F.col("screen")), special, le16(F.col("display")), le16(control), le16(size), body
    )
    length = F.length(inner) / 2 + F.when(F.col("event_id") % 97 == 0, 5).otherwise(0)
    return t.tally.select("event_id", "tai_ns", F.concat(le16(length.cast("int")), inner).alias("hex"))


# The timecode of an instant at 50 frames a second.
TIMECODE = """strftime(make_timestamp({at}//1000000000*1000000), '%H:%M:%S')||':'||lpad(cast(cast((({at}+10000000)//20000000-({at}//1000000000)*50)%50 as int) as varchar),2,'0')"""


TALLY_ROWS = """select event_id, {keys} case when event_id%97<>0 then screen end screen, case when event_id%97<>0 then display end display, case when event_id%97<>0 then lh end lh,
    case when event_id%97<>0 then rh end rh, case when event_id%97<>0 then txt end txt, cast(case when event_id%97<>0 then 3 end as int) brightness,
    case when event_id%97<>0 then 'CAM '||(display+1) end as label, case when event_id%97=0 then 'pbc' end error from tally"""


@query("tally_ingest", TALLY_ROWS.format(keys=""), "tally")
def _(t):
    datagrams = packed(t).select("event_id", F.unhex("hex").alias("data"))
    return tally.datagram_displays(datagrams, ["event_id"])


@query(
    "tally_ingest_stream",
    f"""with r as ({TALLY_ROWS.format(keys='cast(event_id%3 as int) connection,')}) select * exclude (event_id), count(*) n from r group by all""",
    "tally",
)
def _(t):
    # Framed with escapes doubled, then cut into pieces that ignore packet borders.
    stuffed = F.regexp_replace(F.regexp_replace("hex", "(..)", "$1 "), "FE ", "FE FE ")
    framed = F.regexp_replace(F.concat(F.lit("FE02"), stuffed, F.lit("FE03")), " ", "")
    pieces = packed(t).select(
        (F.col("event_id") % 3).cast("int").alias("connection"), "event_id", framed.alias("f")
    )
    cut = pieces.select(
        "connection",
        F.explode(F.array(F.struct((F.col("event_id") * 2).alias("seq"), F.substr("f", F.lit(1), F.lit(14)).alias("h")),
                          F.struct((F.col("event_id") * 2 + 1).alias("seq"), F.substr("f", F.lit(15)).alias("h")))).alias("p"),
    ).select("connection", "p.seq", F.unhex("p.h").alias("data"))
    packets = tally.stream_packets(cut, "connection", "seq")
    rows = tally.parse_packets(packets, ["connection"])
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


@query(
    "status_snapshot",
    f"""with p as (select *, exists (select 1 from clips c where c.camera=f.camera and f.tai_ns between c.in_ns and c.out_ns) prot from frames f),
    c as (select camera, min(tai_ns) oldest_ns, max(tai_ns) newest_ns, count(*) frames, count(*) filter (prot) protected_frames, cast(sum(payload_bytes) as bigint) bytes from p group by 1),
    s as (select channel, arg_max({{{{'mode': mode, 'pos': position_ns, 'speed': speed, 'outs': out_ns, 'angle': angle, 'locked': locked}}}}, grain) s from ({{transport}}) group by channel),
    y as (select display+1 channel, arg_max(case when txt<>0 then txt when rh<>0 then rh else lh end, tai_ns) tally from tally group by display)
    select 'camera' kind, camera id, oldest_ns, newest_ns, frames, protected_frames, bytes, {{newest}} timecode, cast(null as int) tally,
        cast(null as varchar) as mode, cast(null as bigint) position_ns, cast(null as double) speed, cast(null as int) angle, cast(null as boolean) locked, cast(null as bigint) left_ns from c
    union all select 'channel', channel, null, null, null, null, null, {{position}}, tally, s.mode, s.pos, s.speed, s.angle, s.locked,
        case when s.pos>=s.outs then 0 when s.speed>0 then cast(trunc((s.outs-s.pos)/s.speed) as bigint) end from s left join y using (channel)""".format(
        transport=ORACLES["transport_fold"], newest=TIMECODE.format(at="newest_ns"), position=TIMECODE.format(at="s.pos")
    ),
    "frames clips tally",
)
def _(t):
    cams = status.camera_status(t.frames, t.ranges, 50, 1).withColumnRenamed("camera", "id").withColumn("kind", F.lit("camera"))
    channels = status.channel_status(transport_states(t), joins.display_channel(t.tally, ""), "grain", 50, 1)
    rows = channels.withColumnRenamed("channel", "id").withColumn("kind", F.lit("channel"))
    return cams.unionByName(rows, allowMissingColumns=True)
