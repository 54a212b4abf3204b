"""Completeness, drops, stalls, sound and rate conversion."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgrid.operators import ingest
from reelgrid.registry import query

HOUR = 3_600_000_000_000


@query(
    "phase_interleave",
    """with w as (select camera, house_index, phase, arg_max(present, payload_id) present, arg_max(tai_ns, payload_id) t,
        max(payload_id) payload_id from grains group by all),
    h as (select camera, house_index, 3-count(*) filter (present) missing, arg_min(t, phase) filter (present) base from w group by all),
    s as (select h.*, k slot from h, range(3) r(k) where base is not null),
    d as (select s.*, w.phase, w.payload_id, w.t, row_number() over (partition by s.camera, s.house_index, slot order by abs(w.phase-slot), w.phase) rn
        from s join w on w.camera=s.camera and w.house_index=s.house_index and w.present)
    select camera, house_index, cast(missing as int) missing, cast(slot as int) slot, case when phase=slot and t<>0 then t else base end+20000000*slot//3 time_ns,
        phase, payload_id, phase<>slot repeated from d where rn=1
    union all select camera, house_index, 3, null, null, null, null, null from h where base is null""",
    "grains",
)
def _(t):
    return ingest.phase_interleave(t.grains, 3, 20_000_000, "payload_id")


@query(
    "field_weave",
    """with f as (select vec_id grain, luma, event_type<>'error' valid from pictures join events on event_id=vec_id),
    p as (select a.grain//2 frame, a.luma a, b.luma b from f a join f b on b.grain=a.grain+1 where a.grain%2=0 and a.valid and b.valid)
    select frame, list_aggregate(flatten(list_transform(range(8), lambda i: list_concat(a[i*8+1:i*8+8], b[i*8+1:i*8+8]))), 'string_agg', ',') luma from p""",
    "pictures",
)
def _(t):
    valid = t.events.selectExpr("event_id vec_id", "event_type <> 'error' valid")
    fields = t.pictures.join(valid, "vec_id").withColumnRenamed("vec_id", "grain")
    woven = ingest.field_weave(fields, 8, 8)
    return woven.select("frame", F.array_join(F.transform("luma", lambda v: v.cast("string")), ",").alias("luma"))


READER = "case event_type when 'view' then 'wait' when 'click' then 'read' when 'error' then 'late' else 'other' end"


@query(
    "drop_classify",
    f"""with e as (select f.camera, f.tai_ns, f.event_id, {READER} ev from frames f join events using (event_id)),
    s as (select *, last_value(case when ev in ('wait','read') then ev end ignore nulls) over w st,
        last_value(case when ev in ('wait','read') then tai_ns end ignore nulls) over w since from e
        window w as (partition by camera order by tai_ns rows between unbounded preceding and 1 preceding))
    select camera, tai_ns, event_id, not coalesce(st='wait',false) or tai_ns-since>={HOUR} dropped from s where ev='late'""",
    "frames",
)
def _(t):
    events = t.events.selectExpr(
        "cast(user_id % 4 + 1 as int) camera", "unix_micros(cast(ts as timestamp)) * 1000 tai_ns", "event_id", f"{READER} event"
    )
    return ingest.drop_classify(events, HOUR, ["tai_ns"]).select("camera", "tai_ns", "event_id", "dropped")


# Camera 9 connects but never records, others close, open again or have grains that can't be used.
INPUT_EVENTS = """cast(case when user_id % 13 = 0 then 9 else user_id % 4 + 1 end as int) camera;{tai} tai_ns;
    case when user_id % 13 = 0 then case event_type when 'click' then 'connect' when 'view' then 'opened' else 'skipped' end
    else case event_type when 'error' then 'skipped' when 'signup' then 'closed' when 'purchase' then 'opened' else 'recorded' end end event"""

STALLS = f"""with e as (select {INPUT_EVENTS.format(tai='epoch_us(ts)*1000').replace(';', ',')} from events),
    s as (select *, first_value(case when event='recorded' then tai_ns end ignore nulls) over (partition by camera order by tai_ns rows between 1 following and unbounded following) nx,
        last_value(case when event in ('recorded','connect') then tai_ns end ignore nulls) over (partition by camera order by tai_ns rows between unbounded preceding and 1 preceding) pv from e),
    g as (select s.*, tai_ns+{HOUR} at_ns from s where (event='recorded' or (event='connect' and pv is null)) and coalesce(nx, UNTIL)>=tai_ns+{HOUR}),
    k as (select g.camera, g.tai_ns, g.nx, g.at_ns, arg_max(e.event, e.tai_ns) filter (e.event<>'connect') ev,
        max(e.tai_ns) filter (e.event='skipped') sk from g left join e on e.camera=g.camera and e.tai_ns<=g.at_ns group by all)
    select camera, at_ns tai_ns, 'stopped' change, case when coalesce(ev, 'closed')='closed' then 'flow_missing' when sk>tai_ns
        then 'invalid_grains' else 'no_grains' end reason, cast(null as bigint) gap_ns from k
    union all select camera, nx, 'resumed', null, nx-tai_ns from k where nx is not null"""


def input_events(t):
    tai = "unix_micros(cast(ts as timestamp)) * 1000"
    return t.events.selectExpr(*INPUT_EVENTS.format(tai=tai).split(";"))


@query("input_stall", STALLS.replace("UNTIL", "(select max(tai_ns) from e)"))
def _(t):
    events = input_events(t)
    return ingest.input_stalls(events, HOUR, events.agg(F.max("tai_ns")).scalar())


@query(
    "audio_stall",
    """with n as (select camera, tai_ns, audio_ok, row_number() over (partition by camera order by tai_ns) n from frames),
    h as (select *, coalesce(max(case when audio_ok then n end) over (partition by camera order by n rows between unbounded preceding and 1 preceding),0) heard from n),
    c as (select camera, tai_ns, case when audio_ok and n-1-heard>=3 then 'resumed' when not audio_ok and n-heard=3 then 'stopped' end change,
        case when audio_ok then n-1-heard end missed from h)
    select * from c where change is not null""",
    "frames",
)
def _(t):
    return ingest.audio_stalls(t.frames, 3)


CHECKS = """select camera, tai_ns, event_id, 'flow-'||(payload_id%2) flow, case when payload_id%10<4 then 'interlaced'
    when payload_id%10<6 then 'raster' end reason from frames"""


@query(
    "unsupported_once",
    f"""with c as ({CHECKS}), l as (select *, lag(flow) over w f0, lag(reason) over w r0 from c window w as (partition by camera order by tai_ns))
    select camera, tai_ns, event_id, flow, reason from l where reason is not null and not coalesce(r0 is not null and f0=flow, false)""",
    "frames",
)
def _(t):
    checks = t.frames.selectExpr(
        "camera", "tai_ns", "event_id", "concat('flow-', payload_id % 2) flow",
        "case when payload_id % 10 < 4 then 'interlaced' when payload_id % 10 < 6 then 'raster' end reason",
    )
    return ingest.unsupported_once(checks, ["tai_ns"])


@query(
    "audio_attach",
    """with n as (select event_id frame, (cast(event_id as hugeint)*48048000+15000)//30000 a, ((cast(event_id as hugeint)+1)*48048000+15000)//30000 b from events),
    g as (select frame, count(*) c, sum(l) s from n join samples on sample_ix>=a and sample_ix<b group by frame, a, b having count(*)=b-a)
    select n.frame, cast(coalesce(2*c,0) as int) n_samples, round(coalesce(2*s,0),6) total from n left join g using (frame)""",
    "samples",
)
def _(t):
    blocks = t.base("embeddings").selectExpr(
        "vec_id * 64 first_sample", "transform(embedding, e -> cast(e as double)) l", "cast(null as array<double>) r"
    )
    attached = ingest.audio_attach(t.events.selectExpr("event_id frame"), blocks, 30000, 1001)
    total = F.aggregate("audio", F.lit(0.0), lambda a, v: a + v)
    return attached.select("frame", F.size("audio").alias("n_samples"), F.round(total, 6).alias("total"))


@query(
    "recorder_health",
    f"""with m as (select max(tai_ns)+500000000 nw from frames),
    w as (select camera, tai_ns//{HOUR} w, sum(payload_bytes) b, count(*) n, max(tai_ns) l from frames group by all)
    select camera, max(l) newest_ns, cast(sum(n) as bigint) frames, round(max(b/3600.0),6) peak_bytes_per_s,
        round((max(nw)-max(l))/1e9,6) age_s, max(nw)-max(l)<=1000000000 recording from w, m group by camera""",
    "frames",
)
def _(t):
    now = t.frames.agg(F.max("tai_ns") + 500_000_000).scalar()
    health = ingest.recorder_health(t.frames, now, 0, HOUR)
    return health.withColumns({"age_s": F.round("age_s", 6), "peak_bytes_per_s": F.round("peak_bytes_per_s", 6)})


SOURCES = """select user_id file, event_id n, case when event_id%5=0 then -1 else event_id*1000000+(event_id%7-3)*20000000 end start_ns,
    case when event_id%3=0 then 0 else (event_id%4+1)*10000000 end duration_ns from events"""
CLOCK = f"""src as ({SOURCES}), num as (select *, row_number() over (partition by file order by n) i from src),
    clock(file, i, n, at_ns, length_ns) as (
        select file, i, n, greatest(start_ns, 0), case when duration_ns>0 then duration_ns else 40000000 end from num where i=1
        union all select s.file, s.i, s.n, greatest(case when s.start_ns<0 then c.at_ns+c.length_ns else s.start_ns end, c.at_ns),
            case when s.duration_ns>0 then s.duration_ns
                when greatest(case when s.start_ns<0 then c.at_ns+c.length_ns else s.start_ns end, c.at_ns)=c.at_ns then 40000000
                else greatest(case when s.start_ns<0 then c.at_ns+c.length_ns else s.start_ns end, c.at_ns)-c.at_ns end
        from clock c join num s on s.file=c.file and s.i=c.i+1)"""


def sources(t):
    return t.events.selectExpr(
        "user_id file",
        "event_id n",
        "case when event_id % 5 = 0 then -1 else event_id * 1000000 + (event_id % 7 - 3) * 20000000 end start_ns",
        "case when event_id % 3 = 0 then 0 else (event_id % 4 + 1) * 10000000 end duration_ns",
    )


@query("source_clock", f"with recursive {CLOCK} select file, n, at_ns, length_ns from clock")
def _(t):
    return ingest.source_clock(sources(t), 40_000_000)


@query(
    "rate_convert",
    """with src as (select user_id file, event_id n, event_id*1000000+(event_id%7-3)*20000000 start_ns,
        (event_id%4+1)*10000000 duration_ns from events),
    st as (select *, greatest(0, max(start_ns) over (partition by file order by n)) as s0 from src),
    b as (select *, lag(s0) over w pa, lead(s0) over w na from st window w as (partition by file order by n)),
    top as (select file, max(s0+duration_ns)//20000000+3 m from b group by 1),
    h as (select file, g, cast(g*cast(1000000000 as hugeint)*1001//60000 as bigint) t0, cast((g+1)*cast(1000000000 as hugeint)*1001//60000 as bigint) t1
        from top, lateral unnest(range(m*2)) r(g)),
    hit as (select b.file, b.n, h.g house_frame from b join h on h.file=b.file and
        (b.pa is null or 2*h.t0>b.pa+b.s0) and (case when b.na is null then h.t0+h.t1<=2*(b.s0+b.duration_ns) else 2*h.t0<=b.s0+b.na end))
    select file, n, house_frame from hit
    union all select b.file, b.n, 0 from b where b.na is null and not exists (select 1 from hit where hit.file=b.file)""",
)
def _(t):
    source = t.events.selectExpr(
        "user_id file", "event_id n", "greatest(0, event_id * 1000000 + (event_id % 7 - 3) * 20000000) start_ns",
        "(event_id % 4 + 1) * 10000000 duration_ns",
    )
    return ingest.rate_convert(source, 60000, 1001)


@query(
    "live_position",
    """with p1 as (select probe, camera, at_ns-3*20000000 position_ns from probes),
    b as (select p.*, f.tai_ns bt from p1 p asof left join frames f on p.camera=f.camera and p.position_ns>=f.tai_ns),
    n as (select b.*, f.tai_ns nt from b asof left join frames f on b.camera=f.camera and b.position_ns<f.tai_ns)
    select probe, camera, position_ns, case when bt is null or nt-position_ns<position_ns-bt then coalesce(nt,bt) else bt end frame_ns from n""",
    "probes frames",
)
def _(t):
    shown = ingest.live_frames(t.probes.select("probe", "camera", "at_ns"), t.frames, 3, 20_000_000)
    return shown.select("probe", "camera", "position_ns", F.col("frame.tai_ns").alias("frame_ns"))


@query(
    "route_update",
    """with r as (select user_id route, max(event_id) e from events group by 1),
    u as (select user_id route, event_id e, event_type state, event_id%3 sender from events)
    select r.route, true active, 'domain-'||r.route%3 as domain, 'flow-'||r.e flow, cast(0 as bigint) sender,
        coalesce(u.state,'waiting') state from r left join u on u.route=r.route and u.e=r.e and u.sender=0""",
)
def _(t):
    routes = t.events.groupBy(F.col("user_id").alias("route")).agg(F.max("event_id").alias("e")).selectExpr(
        "route", "true active", "concat('domain-', route % 3) domain", "concat('flow-', e) flow", "0L sender", "'waiting' state"
    )
    updates = t.events.selectExpr(
        "user_id route", "true active", "concat('domain-', user_id % 3) domain", "concat('flow-', event_id) flow",
        "event_id % 3 sender", "event_type state", "event_id seq",
    )
    return ingest.route_update(routes, updates, "seq")
