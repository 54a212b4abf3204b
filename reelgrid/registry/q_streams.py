"""Streaming forms, run over the supplied events as a file stream until they are used up."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import functions as F

from reelgrid.operators.ingest import interleaved
from reelgrid.registry import ORACLES, query
from reelgrid.registry.q_ingest import HOUR, STALLS, input_events
from reelgrid.registry.q_playout import SPEED_GRAINS, shot_events, transport_commands
from reelgrid.registry.q_sources import fresh_folder
from reelgrid.registry.tables import Tables
from reelgrid.sources.frames import frame_bounds
from reelgrid.streaming import jobs, state


# The watermark at the end of the events: what is still open beyond it is not written.
LAST = "(select max(tai_ns) from frames)"


#: Rows that arrive between two triggers, and triggers at least, so that state is always carried on.
ARRIVALS, TRIGGERS = 1_000_000, 3


class Streamed(Tables):
    """The same views over the events as a stream whose files arrive in the order ``by``.

    The table is cut into stretches of that order, as many as it is long; each arrives, as files of its own, when the
    stream has used up the ones before. With ``ahead`` all are there before the stream starts, a file each that it
    takes one at a trigger: it is planned, and its state loaded, once and not for each stretch.
    """

    def __init__(self, spark, folder, by="event_id", triggers=None, even=False, ahead=False):
        super().__init__(spark, folder)
        self.by, self.triggers, self.even, self.ahead, self.arriving = F.expr(by), triggers, even, ahead, {}

    def base(self, name):
        static = super().base(name)
        if name not in self.arriving:
            folder = fresh_folder(self.spark, "arrivals")
            count = self.triggers or max(TRIGGERS, -(-static.count() // ARRIVALS))
            if self.even:
                low, high = static.select(F.min(self.by), F.max(self.by)).first()
                bounds = [low + (-(-(high - low + 1) * i // count)) - 1 for i in range(1, count)]
            else:
                # approximate bounds do: rows of one place in the order always arrive together
                shares = [F.lit(i / count) for i in range(1, count)]
                bounds = static.select(F.percentile_approx(self.by, F.array(*shares), 10_000)).first()[0] if shares else []
            cuts = [F.lit(True), *[self.by > b for b in bounds]], [*[self.by <= b for b in bounds], F.lit(True)]
            self.arriving[name] = (folder, [static.filter(low & high) for low, high in zip(*cuts)])
            for n in range(len(self.arriving[name][1]) if self.ahead else 1):
                self.arrive(name, n)
        return jobs.files(self.spark, self.arriving[name][0], static.schema, 1 if self.ahead else 1_000_000)

    def arrive(self, name, n):
        folder, stretches = self.arriving[name]
        if self.ahead:
            stretches[n].repartition(1).write.mode("append").parquet(folder)
        else:
            stretches[n].write.mode("append").option("maxRecordsPerFile", ARRIVALS // 8).parquet(folder)

    def rest(self):
        """Let the later stretches arrive, one at a time."""
        for n in range(1, max(len(s) for _, s in self.arriving.values())):
            for name in self.arriving:
                self.arrive(name, n)
            yield


def run(t, build, by="event_id", triggers=None):
    live = Streamed(t.spark, t.folder, by, triggers)
    return jobs.run_to_table(build(live), fresh_folder(t.spark, "stream"), more=live.rest())


@query(
    "ordered_append_stream",
    """select camera, arrival, event_id, coalesce(tai_ns>max(tai_ns) over (partition by camera order by arrival, event_id rows between unbounded preceding and 1 preceding), true) accepted from frames""",
    "frames",
)
def _(t):
    arrival = "event_id + case when event_id % 7 = 0 then 9 else 0 end"
    frames = lambda s: s.frames.select("camera", "arrival", "event_id", "tai_ns")
    return run(t, lambda s: jobs.ordered_append_stream(frames(s), ["arrival", "event_id"]), arrival)


@query(
    "log_limit_stream",
    """with recursive e as (select channel, tai_ns from commands where kind='error'),
    lines(channel, line_ns) as (select channel, min(tai_ns) from e group by 1
        union all select l.channel, min(e.tai_ns) from lines l join e on e.channel=l.channel and e.tai_ns>=l.line_ns+3600000000000 group by 1),
    p as (select channel, line_ns, lag(line_ns) over (partition by channel order by line_ns) prev from lines)
    select p.channel, p.line_ns tai_ns, case when any_value(prev) is null then 1 else count(e.tai_ns) end events from p
        left join e on e.channel=p.channel and e.tai_ns>p.prev and e.tai_ns<=p.line_ns group by all""",
    "commands",
)
def _(t):
    return run(t, lambda s: jobs.log_limit_stream(s.commands.filter("kind = 'error'").select("channel", "tai_ns"), "channel", HOUR))


@query("tally_play_stream")
def _(t):
    def build(s):
        events = s.commands.selectExpr(
            "channel", "grain", "case when kind = 'click' then concat('clip-', user_id div 40) end shot", "kind in ('error', 'purchase') red"
        )
        return jobs.tally_play_stream(events, ["grain"])

    return run(t, build)


@query("shot_stream")
def _(t):
    return run(t, lambda s: jobs.shot_stream(shot_events(s), ["grain"]))


@query("transport_stream")
def _(t):
    def build(s):
        return jobs.transport_stream(transport_commands(s), ["grain"], 20_000_000, 40_000_000, 4, SPEED_GRAINS)

    return run(t, build)


@query("input_stall_stream", STALLS.replace("UNTIL", "(select max(tai_ns)-600000000000 from e)"))
def _(t):
    live = Streamed(t.spark, t.folder, ahead=True)
    return jobs.run_to_table(state.stall_stream(jobs.event_time(input_events(live), "10 minutes"), HOUR), fresh_folder(t.spark, "stream"))


@query(
    "rate_stream",
    """with w as (select camera, (tai_ns//1000//900000000-k)*900000000 start_us, payload_bytes b from frames, range(4) r(k))
    select camera, start_us, count(*) frames, cast(sum(b) as bigint) bytes from w where start_us+3600000000<=(select max(tai_ns)//1000-600000000 from frames) group by all""",
    "frames",
)
def _(t):
    return run(
        t, lambda s: jobs.rate_stream(jobs.event_time(s.frames, "10 minutes"), "1 hour", "15 minutes", F.col("payload_bytes"))
    )


@query(
    "connected_stream",
    f"""with l as (select camera, tai_ns//1000 us, coalesce(tai_ns//1000-lag(tai_ns//1000) over (partition by camera order by tai_ns)>=1800000000, true) nw from frames),
    i as (select *, sum(case when nw then 1 else 0 end) over (partition by camera order by us) s from l)
    select camera, min(us) start_us, count(*) frames from i group by camera, s having max(us)+1800000000<={LAST}//1000-600000000""",
    "frames",
)
def _(t):
    return run(t, lambda s: jobs.connected_stream(jobs.event_time(s.frames.select("camera", "tai_ns"), "10 minutes"), "30 minutes"))


@query("unsupported_stream")
def _(t):
    def build(s):
        checks = s.frames.selectExpr(
            "camera", "tai_ns", "event_id", "concat('flow-', payload_id % 2) flow",
            "case when payload_id % 10 < 4 then 'interlaced' when payload_id % 10 < 6 then 'raster' end reason",
        )
        return jobs.unsupported_stream(checks, ["tai_ns", "event_id"])

    return run(t, build)


@query(
    "phase_stream",
    f"select * from ({ORACLES['phase_interleave']}) where (house_index*20000000//1000000000+1)*1000000000<=(select max(event_id)//6*20000000-1000000000 from events)",
)
def _(t):
    return run(
        t, lambda s: jobs.phase_stream(s.grains, 3, 20_000_000, "payload_id", "1 second", "1 second")
    )


@query(
    "phase_complete_stream",
    """with s as (select *, event_id e from (select *, payload_id event_id from grains)),
    w as (select *, max(e) filter (present and phase=0) over r p0, max(e) filter (present and phase=1) over r p1, max(e) filter (present and phase=2) over r p2,
        max(e) filter (phase=0) over r q0, max(e) filter (phase=1) over r q1, max(e) filter (phase=2) over r q2 from s window r as (partition by camera, house_index order by e)),
    c as (select *, min(case when p0=q0 and p1=q1 and p2=q2 then e end) over (partition by camera, house_index) full_at, max(house_index) over (partition by camera) last from w),
    k as (select camera, house_index, phase, arg_max(present, e) present, arg_max(tai_ns, e) t, max(e) payload_id, any_value(full_at) full_at from c
        where (full_at is null and house_index<last) or e<=full_at group by camera, house_index, phase),
    h as (select camera, house_index, case when any_value(full_at) is null then 'next' else 'full' end reason, 3-count(*) filter (present) missing, arg_min(t, phase) filter (present) base from k group by camera, house_index),
    z as (select h.*, k slot from h, range(3) r(k) where base is not null),
    d as (select z.*, k.phase, k.payload_id, k.t, row_number() over (partition by z.camera, z.house_index, slot order by abs(k.phase-slot), k.phase) rn
        from z join k on k.camera=z.camera and k.house_index=z.house_index and k.present)
    select camera, house_index, reason, cast(missing as int) missing, cast(slot as int) slot, case when phase=slot and t<>0 then t else base end+20000000*slot//3 time_ns,
        phase, payload_id, phase<>slot repeated from d where rn=1
    union all select camera, house_index, reason, 3, null, null, null, null, null from h where base is null
    union all select camera, house_index, 'late', 0, null, null, phase, payload_id, null from c where e>full_at""",
    "grains",
)
def _(t):
    def build(s):
        end = F.timestamp_micros(F.expr("(house_index + 1) * 20000000 div 1000"))
        return state.house_stream(s.grains.withColumn("ts", end).withWatermark("ts", "1 day"), 3, 20_000_000, "payload_id")

    houses = run(t, build)
    slots = interleaved(houses.filter("reason <> 'late'"), 3, 20_000_000, keep=("reason",))
    only = F.coalesce(*[F.when(F.col(f"_p{k}.present"), F.struct(F.lit(k).alias("phase"), F.col(f"_p{k}.payload_id").alias("payload_id"))) for k in range(3)])
    late = houses.filter("reason = 'late'").select("camera", "house_index", "reason", F.lit(0).alias("missing"), only["phase"].alias("phase"), only["payload_id"].alias("payload_id"))
    return slots.unionByName(late, allowMissingColumns=True)


@query(
    "snapshot_stream",
    "select camera, min(tai_ns) oldest_ns, max(tai_ns) newest_ns, count(*) frames from frames group by 1",
    "frames",
)
def _(t):
    folder = fresh_folder(t.spark, "snapshot")
    live = Streamed(t.spark, t.folder)
    frames = live.frames
    for _ in chain([None], live.rest()):
        jobs.snapshot_sink(frames, folder, frame_bounds, jobs.merged_bounds, every=None).awaitTermination()
    # The last snapshot alone holds the bounds of everything read.
    last = t.spark.read.parquet(folder)
    return last.filter(F.col("snapshot") == last.agg(F.max("snapshot")).first()[0]).drop("snapshot")


@query(
    "display_map_stream",
    """with t as (select min(event_id) lo, max(event_id)-min(event_id)+1 wide from tally)
    select event_id, display, cast((display+(event_id-lo)*3//wide)%4 as int) channel from tally, t""",
    "tally",
)
def _(t):
    """Whom a display belongs to changes between triggers: rows are placed by the map of their time."""
    folder = fresh_folder(t.spark, "mapped")
    live = Streamed(t.spark, t.folder, triggers=3, even=True)
    tally = live.tally.select("event_id", "display")
    for n, _ in enumerate(chain([None], live.rest())):
        # another process rewrites the map before the next rows arrive
        t.spark.range(8).selectExpr("cast(id as int) display", f"cast((id + {n}) % 4 as int) channel").write.mode("overwrite").parquet(f"{folder}/map")
        read_map = lambda spark: spark.read.parquet(f"{folder}/map")
        sink = jobs.with_dimension(tally, folder, read_map, lambda rows, side: rows.join(side, "display"))
        sink.trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{folder}/rows").select("event_id", "display", "channel")


# The streams give what the batch operators give.
for _name, _batch in (("tally_play_stream", "tally_play"), ("shot_stream", "shot_state"), ("transport_stream", "transport_fold"), ("unsupported_stream", "unsupported_once")):
    ORACLES[_name] = ORACLES[_batch]
