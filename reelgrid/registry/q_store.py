"""Ordered append, segments, retention and protection."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgrid.operators import store
from reelgrid.registry import query

HOUR = 3_600_000_000_000
MINUTE = 60_000_000_000
RETENTION = 7 * 24 * HOUR

# Segments of one hour, cut greedily: the SQL follows the cuts one by one.
SEGS = f"""segfirst(camera, first_ns) as (
        select camera, min(tai_ns) from frames group by 1
        union all select s.camera, min(f.tai_ns) from segfirst s join frames f on f.camera=s.camera and f.tai_ns>s.first_ns+{HOUR} group by s.camera),
    assigned as (select f.*, s.first_ns from frames f asof join segfirst s on f.camera=s.camera and f.tai_ns>=s.first_ns),
    numbered as (select camera, first_ns, row_number() over (partition by camera order by first_ns)-1 segment from segfirst),
    segs as (select a.camera, n.segment, min(a.tai_ns) first_ns, max(a.tai_ns) last_ns, count(*) frames,
        cast(sum(a.payload_bytes+16)+8 as bigint) bytes from assigned a join numbered n using (camera, first_ns) group by 1,2),
    segments as (select *, segment=max(segment) over (partition by camera) is_open from segs),
    held as (select camera, in_ns b, out_ns e from clips where not library)"""
RECURSIVE = "with recursive " + SEGS


def segments(t):
    return store.segment_stats(store.segment_assign(t.frames, HOUR, ["payload_bytes"]))


def held(t):
    return store.range_holders(t.clips).selectExpr("camera", "in_ns begin_ns", "out_ns end_ns")


@query(
    "ordered_append",
    f"""with a as (select camera, tai_ns//{MINUTE}*{MINUTE} tai_ns, arrival, event_id from frames),
    k as (select a.*, exists (select 1 from clips c where c.camera=a.camera and a.tai_ns between c.in_ns and c.out_ns) kept from a),
    m as (select *, max(tai_ns) over (partition by camera order by arrival, event_id rows between unbounded preceding and 1 preceding) newest from k),
    j as (select *, coalesce(tai_ns>newest or (tai_ns=newest and not kept), true) taken from m),
    n as (select *, lead(case when taken then tai_ns end ignore nulls) over (partition by camera order by arrival, event_id) nxt from j)
    select camera, tai_ns, arrival, event_id, case when not taken then 'dropped' when nxt=tai_ns then 'replaced' else 'stored' end verdict from n""",
    "frames clips",
)
def _(t):
    arrivals = t.frames.selectExpr("camera", f"tai_ns div {MINUTE} * {MINUTE} tai_ns", "arrival", "event_id")
    return store.ordered_append(arrivals, t.ranges, ["arrival", "event_id"])


@query(
    "segment_assign",
    RECURSIVE + " select camera, tai_ns, segment, first_ns from assigned join numbered using (camera, first_ns)",
    "frames clips",
)
def _(t):
    return store.segment_assign(t.frames, HOUR)


@query(
    "segment_stats",
    RECURSIVE + " select camera, segment, first_ns, last_ns, frames, bytes, is_open from segments",
    "frames clips",
)
def _(t):
    return segments(t)


@query(
    "retention",
    RECURSIVE
    + f""", newest as (select camera, max(last_ns) newest from segments group by 1),
    p as (select s.*, exists (select 1 from held h where h.camera=s.camera and h.b<=s.last_ns and h.e>=s.first_ns) protected from segments s)
    select p.camera, segment, first_ns, last_ns, protected,
        newest>{RETENTION} and last_ns<newest-{RETENTION} and not is_open and not protected expired from p join newest using (camera)""",
    "frames clips",
)
def _(t):
    return store.retention(segments(t), held(t), RETENTION).select(
        "camera", "segment", "first_ns", "last_ns", "protected", "expired"
    )


@query(
    "protect_mark",
    """select event_id, camera, tai_ns, exists (select 1 from clips c where c.camera=f.camera
        and f.tai_ns between c.in_ns and c.out_ns) protected from frames f""",
    "frames clips",
)
def _(t):
    return store.protect_mark(t.frames.select("event_id", "camera", "tai_ns"), t.ranges)


@query(
    "range_release",
    f"""with r as (select camera, in_ns//{HOUR}*{HOUR} b, in_ns//{HOUR}*{HOUR}+{HOUR} e, library from clips),
    h as (select camera, b, e, count(*) held, count(*) filter (library) gone from r group by all)
    select camera, b begin_ns, e end_ns, held-gone holders from h where held>gone""",
    "clips",
)
def _(t):
    bag = t.clips.selectExpr(
        "camera", f"in_ns div {HOUR} * {HOUR} begin_ns", f"in_ns div {HOUR} * {HOUR} + {HOUR} end_ns", "library"
    )
    return store.range_release(bag, bag.filter("library"))


@query("range_holders", "select id, camera, in_ns, out_ns from clips where camera=0 or not library", "clips")
def _(t):
    return store.range_holders(t.clips).select("id", "camera", "in_ns", "out_ns")


@query(
    "discard_from",
    RECURSIVE
    + """, mid as (select (min(tai_ns)+max(tai_ns))//2 t from frames)
    select camera, segment, first_ns, last_ns, frames from segments s, mid where first_ns>=t
        and not exists (select 1 from held h where h.camera=s.camera and h.b<=s.last_ns and h.e>=s.first_ns)""",
    "frames clips",
)
def _(t):
    middle = t.frames.agg(F.expr("(min(tai_ns) + max(tai_ns)) div 2")).scalar()
    return store.discard_from(segments(t), held(t), middle).select("camera", "segment", "first_ns", "last_ns", "frames")


PROTECTED = RECURSIVE + """, p as (select s.*, exists (select 1 from held h where h.camera=s.camera and h.b<=s.last_ns and h.e>=s.first_ns) hit from segments s),
    pb as (select camera, cast(sum(case when hit then bytes else 0 end) as bigint) protected_bytes, cast(sum(bytes) as bigint) disk_bytes from p group by 1)"""


@query(
    "protected_bytes",
    PROTECTED + " select *, round(100.0*protected_bytes/disk_bytes,6) as percent from pb",
    "frames clips",
)
def _(t):
    return store.protected_bytes(segments(t), held(t)).withColumn("percent", F.round("percent", 6))


# Configured buffers of the fixtures: rate and hours; small pictures, so the test data comes near the cap.
BUFFERS = "(1, 50, 1.0), (2, 150, 1.0), (3, 150, 0.5)"
SIZE = (16, 8, 46)
EST = "16*8*0.1875*(46/92.0)*fps*3600.0*hours"


def buffers(t):
    return t.spark.sql(f"select camera, fps, cast(hours as double) hours from values {BUFFERS} as c(camera, fps, hours)")


@query(
    "protection_cap",
    PROTECTED
    + f""", cams as (select * from (values {BUFFERS}) c(camera, fps, hours)),
    s as (select cast(sum(coalesce(protected_bytes,0)) as bigint) protected_bytes, cast(sum(cast(floor({EST}) as bigint)) as bigint) budget_bytes
        from cams left join pb using (camera))
    select *, budget_bytes>0 and 100.0*protected_bytes/budget_bytes>=20 over_cap from s""",
    "frames clips",
)
def _(t):
    return store.protection_cap(store.protected_bytes(segments(t), held(t)), buffers(t), *SIZE, 20.0)


UPLOADS = "case event_type when 'purchase' then cast(floor(value*1000000) as bigint) else cast(floor(value*20000) as bigint) end bytes"


@query(
    "capacity_plan",
    f"""with cams as (select * from (values {BUFFERS}) c(camera, fps, hours)),
    disk as (select camera, cast(sum(payload_bytes) as bigint) used from frames group by 1),
    pl as (select cast(sum(cast(floor({EST}+hours*1382400000) as bigint)) as bigint) need, cast(sum(coalesce(used,0)) as bigint) used
        from cams left join disk using (camera)),
    g as (select greatest(need-used,0) growth from pl)
    select event_id, {UPLOADS}, growth growth_bytes, case when {UPLOADS.replace(' bytes', '')}>256*1024*1024 then 413
        when 6000000000 < ({UPLOADS.replace(' bytes', '')})*9+growth+1073741824 then 507 else 0 end status from events, g""",
    "frames",
)
def _(t):
    disk = t.frames.groupBy("camera").agg(F.sum("payload_bytes").alias("disk_bytes"))
    growth = store.capacity_plan(buffers(t), disk, 6_000_000_000, *SIZE).select("growth_bytes").scalar()
    requests = t.events.selectExpr("event_id", UPLOADS).withColumn("growth_bytes", growth)
    return store.admit_uploads(requests, F.col("growth_bytes"), F.lit(6_000_000_000), 256)


@query(
    "stale_cameras",
    """with stored as (select cast(user_id%9+1 as int) camera, cast(sum(1000+event_id%977) as bigint) bytes from events group by 1)
    select camera, bytes from stored where camera not in (1,2,3) and camera not in (select camera from clips)""",
    "clips",
)
def _(t):
    stored = t.events.selectExpr("cast(user_id % 9 + 1 as int) camera", "1000 + event_id % 977 b").groupBy("camera").agg(
        F.sum("b").alias("bytes")
    )
    configured = t.spark.sql("select * from values (1), (2), (3) as c(camera)")
    return store.stale_cameras(stored, configured, t.clips)


@query(
    "upload_place",
    """with n as (select max(tai_ns) newest from frames),
    u as (select doc_id upload, n_chars frames, sum(n_chars) over (order by doc_id) - n_chars before from documents)
    select upload, frames, cast((newest//20000000+1)*20000000+before*20000000 as bigint) in_ns,
        cast((newest//20000000+1)*20000000+(before+frames-1)*20000000 as bigint) out_ns from u, n""",
    "frames",
)
def _(t):
    newest = t.frames.agg(F.max("tai_ns")).scalar()
    uploads = t.base("documents").select(F.col("doc_id").alias("upload"), F.col("n_chars").alias("frames"))
    return store.upload_place(uploads.withColumn("_newest", newest), F.col("_newest"), 20_000_000).drop("_newest")


@query(
    "repeated_picture",
    """with l as (select camera, tai_ns, payload_id//10 pic, lag(payload_id//10) over (partition by camera order by tai_ns) was from frames),
    r as (select *, coalesce(pic=was,false) repeated from l)
    select camera, tai_ns, pic, repeated, cast(count(*) filter (not repeated) over (partition by camera order by tai_ns) as bigint) picture_run from r""",
    "frames",
)
def _(t):
    pictures = t.frames.selectExpr("camera", "tai_ns", "payload_id div 10 pic")
    return store.repeated_pictures(pictures, "pic")
