"""Frame lookups and catalogue joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgrid.operators import catalog, joins
from reelgrid.plans.intervals import overlap_join
from reelgrid.registry import query

# Nearest frame in SQL: the frames on both sides, the earlier one on a tie, the only one at either end.
NEAREST = """b as (select p.*, f.tai_ns bt, f.event_id be, f.audio_ok ba from {p} p asof left join frames f on p.camera=f.camera and p.{at}>=f.tai_ns),
    n as (select b.*, f.tai_ns nt, f.event_id ne, f.audio_ok na from b asof left join frames f on b.camera=f.camera and b.{at}<f.tai_ns),
    near as (select *, bt is null or nt-{at}<{at}-bt take_next from n),
    found as (select *, case when take_next then coalesce(nt,bt) else bt end frame_ns, case when take_next then coalesce(ne,be) else be end frame_id,
        case when take_next then coalesce(na,ba) else ba end audio_ok from near)"""


@query(
    "nearest_frame",
    "with " + NEAREST.format(p="probes", at="at_ns") + """ select probe, camera, at_ns, frame_ns, frame_id, frame_ns-at_ns off_ns,
        strftime(make_timestamp(frame_ns//1000000000*1000000), '%H:%M:%S')||':'||
        lpad(cast(cast(((frame_ns+10000000)//20000000-(frame_ns//1000000000)*50)%50 as int) as varchar),2,'0') tc from found""",
    "probes frames",
)
def _(t):
    return joins.shown_frames(t.probes.drop("channel"), t.frames.select("camera", "tai_ns", "event_id"), 50, 1, in_order=True)


@query(
    "asof_before",
    """select p.probe, p.camera, p.at_ns, f.tai_ns frame_ns, f.event_id frame_id from probes p
        asof left join frames f on p.camera=f.camera and p.at_ns>=f.tai_ns""",
    "probes frames",
)
def _(t):
    found = joins.at_or_before(t.probes.drop("channel"), t.frames, columns=["event_id"])
    return found.select("probe", "camera", "at_ns", F.col("frame.tai_ns").alias("frame_ns"), F.col("frame.event_id").alias("frame_id"))


@query(
    "asof_after",
    """select p.probe, p.camera, p.at_ns, f.tai_ns frame_ns, f.event_id frame_id from probes p
        asof left join frames f on p.camera=f.camera and p.at_ns<f.tai_ns""",
    "probes frames",
)
def _(t):
    found = joins.after(t.probes.drop("channel"), t.frames, columns=["event_id"], in_order=True)
    return found.select("probe", "camera", "at_ns", F.col("frame.tai_ns").alias("frame_ns"), F.col("frame.event_id").alias("frame_id"))


@query(
    "nearest_audio",
    "with p1 as (select probe, camera, (at_ns+7000000+10000000)//20000000*20000000 audio_ns from probes), "
    + NEAREST.format(p="p1", at="audio_ns")
    + " select probe, camera, audio_ns, frame_ns, audio_ok from found",
    "probes frames",
)
def _(t):
    shifted = t.probes.select("probe", "camera", (F.col("at_ns") + 7_000_000).alias("at_ns"))
    found = joins.nearest_audio(shifted, t.frames, 20_000_000, ["event_id", "audio_ok"], in_order=True)
    return found.select("probe", "camera", "audio_ns", F.col("frame.tai_ns").alias("frame_ns"), "frame.audio_ok")


@query(
    "snap_to_frame",
    "with " + NEAREST.format(p="probes", at="at_ns") + " select probe, camera, at_ns, case when abs(frame_ns-at_ns)<=60000000000 then frame_ns end snapped_ns from found",
    "probes frames",
)
def _(t):
    return joins.snap_to_frame(t.probes.drop("channel"), t.frames, "at_ns", 60_000_000_000)


@query(
    "angle_align",
    "with p1 as (select probe, c camera, at_ns from probes, (select distinct camera c from frames)), "
    + NEAREST.format(p="p1", at="at_ns")
    + " select probe, camera, at_ns, frame_ns from found",
    "probes frames",
)
def _(t):
    found = joins.angle_align(t.probes.select("probe", "at_ns"), t.frames.select("camera"), t.frames)
    return found.select("probe", "camera", "at_ns", F.col("frame.tai_ns").alias("frame_ns"))


VIEW_NS = 600_000_000_000


@query(
    "interval_overlap",
    f"""with v as (select user_id, cast(user_id%4+1 as int) camera, max(epoch_us(ts)*1000) at_ns from events where event_type='click' group by all)
    select v.user_id, v.camera, c.id, c.in_ns, c.out_ns from v join clips c on v.camera=c.camera
        and c.in_ns<=v.at_ns+{VIEW_NS} and c.out_ns>=v.at_ns-{VIEW_NS}""",
    "clips",
)
def _(t):
    clicks = t.events.filter("event_type = 'click'").selectExpr(
        "user_id", "cast(user_id % 4 + 1 as int) camera", "unix_micros(cast(ts as timestamp)) * 1000 at_ns"
    )
    views = clicks.groupBy("user_id", "camera").agg(F.max("at_ns").alias("at_ns"))
    windows = views.select(
        "user_id", "camera", (F.col("at_ns") - VIEW_NS).alias("from_ns"), (F.col("at_ns") + VIEW_NS).alias("to_ns")
    )
    marks = t.clips.select("camera", "id", "in_ns", "out_ns")
    pairs = overlap_join(marks, windows, ["camera"], ("in_ns", "out_ns"), ("from_ns", "to_ns"))
    return pairs.select("user_id", "camera", "id", "in_ns", "out_ns")


@query(
    "entry_clip",
    """select playlist, position, clip_id, c.in_ns clip_in_ns, c.out_ns clip_out_ns, c.id is not null present
        from entries e left join clips c on c.id=e.clip_id""",
    "entries clips",
)
def _(t):
    return catalog.with_clips(t.entries, t.clips, ["in_ns", "out_ns"]).select(
        "playlist", "position", "clip_id", "clip_in_ns", "clip_out_ns", "present"
    )


@query(
    "unknown_clip",
    """with ed as (select playlist, position, case when position%3=1 then 'clip-'||(position*1000) else clip_id end clip_id from entries),
    m as (select * from ed where not exists (select 1 from clips c where c.id=ed.clip_id)
        and not exists (select 1 from entries e where e.playlist=ed.playlist and e.clip_id=ed.clip_id))
    select playlist, min(position) as position, arg_min(clip_id, position) clip_id from m group by 1""",
    "entries clips",
)
def _(t):
    edits = t.entries.selectExpr(
        "playlist", "position", "case when position % 3 = 1 then concat('clip-', position * 1000) else clip_id end clip_id"
    )
    return catalog.unknown_clips(edits, t.clips, t.entries)


@query(
    "dangling_aux",
    """with a as (select 'playlist-'||conv_id playlist, case when conv_id%3=0 then 'audio-'||(conv_id*3) when conv_id%3=1 then '' else
        'clip-'||(conv_id*7) end source from conversations where turn=0),
    k as (select id from clips union all select 'audio-'||vec_id from embeddings)
    select playlist, source, source<>'' and k.id is null dangling, case when source<>'' and k.id is null then '' else source end cleared
    from a left join k on k.id=a.source""",
    "clips",
)
def _(t):
    lists = t.base("conversations").filter("turn = 0").selectExpr(
        "concat('playlist-', conv_id) playlist",
        "case conv_id % 3 when 0 then concat('audio-', conv_id * 3) when 1 then '' else concat('clip-', conv_id * 7) end source",
    )
    audio = t.base("embeddings").select(F.concat(F.lit("audio-"), "vec_id").alias("id"))
    return joins.dangling(lists, "source", t.clips.select("id").unionByName(audio))


@query(
    "display_channel",
    "select event_id, tai_ns, display, case display when 0 then 2 else 4 end channel from tally where screen=1 and display in (0,2)",
    "tally",
)
def _(t):
    return joins.display_channel(t.tally, "0:2,2:4", 1).select("event_id", "tai_ns", "display", "channel")


@query(
    "locked_channel",
    """with p as (select event_id//3 grain, cast(event_id%3+1 as int) channel, tai_ns as position from frames)
    select p.grain, p.channel, case when p.channel=3 then coalesce(f.position, p.position) else p.position end as position
    from p left join p f on f.grain=p.grain and f.channel=1""",
    "frames",
)
def _(t):
    positions = t.frames.selectExpr("event_id div 3 grain", "cast(event_id % 3 + 1 as int) channel", "tai_ns position")
    return joins.locked_positions(positions, F.col("channel") == 3)
