"""From source grains to recordable frames: phases, fields, drops, stalls, sound and rate conversion."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from reelgrid.functions.timebase import idiv, samples_until
from reelgrid.operators.catalog import latest
from reelgrid.plans.asof import nearest
from reelgrid.plans.fold import Machine, Rows, fold_timeline
from reelgrid.plans.ordered import (
    following_row,
    last_value,
    next_value,
    over_timeline,
    previous_row,
    running,
    running_count,
    running_max,
    spread,
)


def phase_interleave(grains: DataFrame, phases: int, house_ns: int, order: str) -> DataFrame:
    """One row per output slot of a house grain: its time, payload, the phase it came from and ``repeated``.

    The last write of each phase counts. A missing phase shows the nearest present one (the lower on a tie) at the
    time of its own slot. A house grain with nothing present gives one row without a slot and all phases missing.
    """
    houses = grains.groupBy("camera", "house_index").agg(*last_writes(phases, order))
    return interleaved(houses, phases, house_ns)


def last_writes(phases: int, order: str) -> list[Column]:
    """The last write of each phase, as structs ``_p0`` on; aggregates of a house grain's rows."""
    write = F.struct("present", F.col("tai_ns").alias("t"), "payload_id")
    of = lambda k, value: F.when(F.col("phase") == k, value)
    return [F.max_by(of(k, write), of(k, F.col(order))).alias(f"_p{k}") for k in range(phases)]


def interleaved(houses: DataFrame, phases: int, house_ns: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """The slots of house grains whose last writes are known, with the columns ``keep``."""
    there = [F.coalesce(F.col(f"_p{k}.present"), F.lit(False)) for k in range(phases)]
    base = F.coalesce(*[F.when(there[k], F.col(f"_p{k}.t")) for k in range(phases)])
    slots = []
    for k in range(phases):
        donors = sorted(range(phases), key=lambda j: (abs(j - k), j))
        donor = F.coalesce(*[F.when(there[j], F.lit(j)) for j in donors])
        payload = F.coalesce(*[F.when(there[j], F.col(f"_p{j}.payload_id")) for j in donors])
        own = F.when(there[k] & (F.col(f"_p{k}.t") != 0), F.col(f"_p{k}.t")).otherwise(base)
        slots.append(
            F.struct(
                F.lit(k).alias("slot"),
                (own + house_ns * k // phases).alias("time_ns"),
                donor.alias("phase"),
                payload.alias("payload_id"),
                (~there[k]).alias("repeated"),
            )
        )
    missing = sum((F.when(t, 0).otherwise(1) for t in there), F.lit(0))
    shown = F.when(base.isNotNull(), F.array(*slots))
    return houses.select("camera", "house_index", *keep, missing.alias("missing"), F.explode_outer(shown).alias("_s")).select(
        "camera", "house_index", *keep, "missing", "_s.*"
    )


def field_weave(fields: DataFrame, line: int, lines: int, top_first: bool = True) -> DataFrame:
    """Frames from pairs of fields 2k and 2k + 1 that are both there and valid; their lines alternate.

    ``line`` samples make a line and ``lines`` lines a field; a bottom field first pair swaps the two.
    """
    usable = fields.filter("valid")
    side = lambda odd: F.any_value(F.when(F.col("grain") % 2 == odd, F.col("luma")), ignoreNulls=True)
    pairs = usable.groupBy(idiv("grain", 2).alias("frame")).agg(side(0).alias("_a"), side(1).alias("_b"))
    first, second = ("_a", "_b") if top_first else ("_b", "_a")
    woven = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(lines - 1)),
            lambda i: F.concat(F.slice(first, i * line + 1, line), F.slice(second, i * line + 1, line)),
        )
    )
    return pairs.filter("_a is not null and _b is not null").select("frame", woven.alias("luma"))


def field_of(luma, parity: int, line: int, lines: int) -> Column:
    """The lines of one field of a woven frame of ``lines`` lines."""
    kept = F.filter(F.sequence(F.lit(0), F.lit(lines - 1)), lambda i: i % 2 == parity)
    return F.flatten(F.transform(kept, lambda i: F.slice(luma, i * line + 1, line)))


def drop_classify(events: DataFrame, history_ns: int, order: list[str]) -> DataFrame:
    """Late grains with ``dropped``: lost unless the reader had waited for it for less than the history.

    ``event`` is wait, read or late; a read ends a wait, and each wait starts it anew.
    """
    mark = F.when(F.col("event").isin("wait", "read"), F.struct("event", "tai_ns"))
    seen = over_timeline(events, ["camera"], order, _state=last_value(mark, before=True))
    waiting = F.coalesce(F.col("_state.event") == "wait", F.lit(False))
    dropped = ~waiting | (F.col("tai_ns") - F.col("_state.tai_ns") >= history_ns)
    return seen.filter("event = 'late'").withColumn("dropped", dropped).drop("_state")


def input_stalls(events: DataFrame, timeout_ns: int, until_ns: Column) -> DataFrame:
    """``stopped`` (with a reason) and ``resumed`` (with the gap) events of each camera input.

    ``event`` is connect, opened, recorded, skipped (read, not recordable) or closed (flow not there). The clock starts
    with the connection, or else the first recorded grain. An input stops when nothing was recorded for the timeout,
    because its flow isn't open at that moment, because grains since the last recorded one could not be used, or
    because none came; its next recorded grain resumes it.
    """
    event = F.col("event")
    instant = lambda *kinds: F.when(event.isin(*kinds), F.col("tai_ns"))
    seen = over_timeline(
        events.select("camera", "tai_ns", "event"),
        ["camera"],
        ["tai_ns"],
        _next=next_value(instant("recorded")),
        _before=last_value(instant("recorded", "connect"), before=True),
    )
    clocks = seen.filter((event == "recorded") | ((event == "connect") & F.col("_before").isNull()))
    at = (F.col("tai_ns") + timeout_ns).alias("tai_ns")
    stops = clocks.filter(F.coalesce("_next", until_ns) >= F.col("tai_ns") + timeout_ns).select(
        "camera", at, F.lit("stop").alias("event"), F.lit(1).alias("_late"), F.col("tai_ns").alias("_since"), "_next"
    )
    # what is known at a stop: the flow's last opening or closing, and the last grain that could not be used
    line = events.select("camera", "tai_ns", "event", F.lit(0).alias("_late")).unionByName(stops, allowMissingColumns=True)
    opened = F.when(event == "closed", F.lit(False)).when(event.isin("opened", "recorded", "skipped"), F.lit(True))
    known = over_timeline(
        line, ["camera"], ["tai_ns", "_late"], _open=last_value(opened), _skip=last_value(instant("skipped"))
    ).filter("_late = 1")
    reason = (
        F.when(~F.coalesce("_open", F.lit(False)), "flow_missing")
        .when(F.col("_skip") > F.col("_since"), "invalid_grains")
        .otherwise("no_grains")
    )
    no_gap = F.lit(None).cast("long")
    stopped = F.struct("tai_ns", F.lit("stopped").alias("change"), reason.alias("reason"), no_gap.alias("gap_ns"))
    resumed = F.struct(
        F.col("_next").alias("tai_ns"), F.lit("resumed").alias("change"), F.lit(None).cast("string").alias("reason"),
        (F.col("_next") - F.col("_since")).alias("gap_ns"),
    )
    happened = F.when(F.col("_next").isNull(), F.array(stopped)).otherwise(F.array(stopped, resumed))
    return known.select("camera", F.explode(happened).alias("_e")).select("camera", "_e.*")


def audio_stalls(frames: DataFrame, limit: int) -> DataFrame:
    """Sound ``stopped`` after ``limit`` recorded frames in a row without samples, ``resumed`` with the missed count."""
    cut = spread(frames.select("camera", "tai_ns", "audio_ok"), ["camera"], ["tai_ns"])
    numbered = running(cut, ["camera"], ["tai_ns"], _n=running_count())
    heard = running(
        numbered, ["camera"], ["tai_ns"], again=True, _heard=last_value(F.when(F.col("audio_ok"), F.col("_n")), before=True)
    )
    missed = F.col("_n") - 1 - F.coalesce("_heard", F.lit(0))
    change = F.when(F.col("audio_ok") & (missed >= limit), "resumed").when(
        ~F.col("audio_ok") & (missed + 1 == limit), "stopped"
    )
    return heard.select(
        "camera", "tai_ns", change.alias("change"), F.when(F.col("audio_ok"), missed).alias("missed")
    ).filter("change is not null")


def unsupported_once(checks: DataFrame, order: list[str]) -> DataFrame:
    """The first report of an unsupported flow; it is reported again only after the route changed or worked."""
    seen = over_timeline(checks, ["camera"], order, _was=previous_row("flow", "reason"))
    known = F.col("_was.reason").isNotNull() & (F.col("_was.flow") == F.col("flow"))
    return seen.filter(F.col("reason").isNotNull() & ~F.coalesce(known, F.lit(False))).drop("_was")


def audio_attach(frames: DataFrame, blocks: DataFrame, num: int, den: int, sample_rate: int = 48000) -> DataFrame:
    """Attach to frame n its samples, interleaved for two channels; empty when any of them is missing.

    ``blocks``: first sample number, ``l`` and ``r`` arrays (``r`` null for a mono source, which is doubled). A block
    is sliced for the few frames it reaches, and the slices of a frame, at most its cadence, are put together.
    """
    first, size = F.col("first_sample"), F.size("l").cast("long")
    per = lambda s: idiv(s * num, sample_rate * den)
    lo = F.greatest(per(first) - 1, F.lit(0).cast("long"))
    reach = F.explode(F.sequence(lo, per(first + size) + 1))
    begin = F.greatest(samples_until("frame", num, den, sample_rate), first)
    end = F.least(samples_until(F.col("frame") + 1, num, den, sample_rate), first + size)
    cut = lambda c: F.slice(c, (F.col("_from") - first + 1).cast("int"), (F.col("_to") - F.col("_from")).cast("int"))
    pieces = (
        blocks.withColumn("frame", reach)
        .withColumn("_from", begin)
        .withColumn("_to", end)
        .filter("_from < _to")
        .select("frame", F.struct("_from", cut("l").alias("l"), cut(F.coalesce("r", "l")).alias("r")).alias("_piece"))
    )
    joined = pieces.groupBy("frame").agg(F.sort_array(F.collect_list("_piece")).alias("_pieces"))
    pair = F.flatten(F.transform("_pieces", lambda p: F.flatten(F.zip_with(p["l"], p["r"], lambda a, b: F.array(a, b)))))
    want = 2 * (samples_until(F.col("frame") + 1, num, den, sample_rate) - samples_until("frame", num, den, sample_rate))
    whole = joined.select("frame", pair.alias("audio")).filter(F.size("audio") == want)
    return frames.join(whole, "frame", "left").withColumn("audio", F.coalesce("audio", F.array().cast("array<double>")))


def recorder_health(frames: DataFrame, now_ns: Column, started_ns: int, window_ns: int) -> DataFrame:
    """Per camera: age of its newest frame, whether it records (a frame in the last second), and its best write rate."""
    slices = frames.groupBy("camera", idiv("tai_ns", window_ns).alias("_w")).agg(
        F.sum("payload_bytes").alias("_bytes"), F.count("*").alias("_n"), F.max("tai_ns").alias("_last")
    )
    newest = F.greatest(F.col("newest_ns"), F.lit(started_ns))
    age = F.greatest(F.col("_now") - newest, F.lit(0).cast("long")) / 1e9
    return (
        slices.groupBy("camera")
        .agg(
            F.max("_last").alias("newest_ns"),
            F.sum("_n").alias("frames"),
            F.max(F.col("_bytes") / (window_ns / 1e9)).alias("peak_bytes_per_s"),
        )
        .withColumn("_now", now_ns)
        .withColumn("age_s", age)
        .withColumn("recording", F.col("_now") - F.col("newest_ns") <= 1_000_000_000)
        .drop("_now")
    )


#: Straight pieces up to which a clock's effect is followed exactly.
CLOCK_PIECES = 32


def clock_machine(fallback_ns: int) -> Machine:
    """Start and duration of decoded frames, one after the other.

    Frames without a time move the start before them by a fixed way. From the first timed frame on all depends on that
    start alone, by a function of straight pieces. Where frames lack durations too, each step may bend it again; beyond
    ``CLOCK_PIECES`` only its bounds are followed, until a timed frame with a duration comes after them all. A chunk
    without such a frame has no effect and is walked when its state is known.
    """

    def step(state: str | None, rows: Rows) -> tuple[Rows, str]:
        last, length = json.loads(state) if state else (None, 0)
        starts, lengths = [], []
        for at, duration in zip(rows["start_ns"], rows["duration_ns"], strict=True):
            if last is None:
                at, step_ns = max(at, 0), 0
            else:
                at = max(last + length if at < 0 else at, last)
                step_ns = at - last
            length = duration if duration > 0 else step_ns or fallback_ns
            starts.append(at)
            lengths.append(length)
            last = at
        return {"at_ns": starts, "length_ns": lengths}, json.dumps([last, length])

    # A piece is (begin, end, (p, q), (r, s)): for x from begin to before end, the start is p + q x, the length r + s x.
    def halves(piece: tuple, at: int) -> list[tuple[int, int | None, bool]]:
        """The parts of a piece that start before ``at`` and that don't."""
        begin, end, (p, q), _ = piece
        if q == 0:
            return [(begin, end, p < at)]
        edge = -((p - at) // q) if q > 0 else (p - at) // -q + 1
        if edge <= begin or (end is not None and edge >= end):
            return [(begin, end, (q < 0) == (edge <= begin))]
        return [(begin, edge, q > 0), (edge, end, q < 0)]

    def joined(pieces: list[tuple]) -> list[tuple]:
        found: list[tuple] = []
        for begin, end, *lines in pieces:
            if found and found[-1][2:] == tuple(lines):
                begin = found.pop()[0]
            found.append((begin, end, *lines))
        return found

    def timed(pieces: list[tuple], at: int, duration: int) -> list[tuple]:
        found = []
        for piece in pieces:
            p, q = piece[2]
            for begin, end, before in halves(piece, at):
                length = (duration, 0) if duration > 0 else (at - p, -q) if before else (fallback_ns, 0)
                found.append((begin, end, (at, 0) if before else (p, q), length))
        return joined(found)

    def bounded(bounds: tuple, at: int, duration: int) -> tuple:
        """Bounds of what is too bent: its end, least and greatest start, greatest length."""
        end, least, most, length = bounds
        if at < 0:
            return end, least, most + length, duration if duration > 0 else length
        return end, max(least, at), max(most, at), duration if duration > 0 else max(at - least, fallback_ns)

    def given_up(pieces: list[tuple], bounds: tuple | None) -> tuple[list[tuple], tuple]:
        """Keep the last piece, in which the start before is later than all frames, and the bounds of the others."""
        ends = [(p + q * x, r + s * x) for b, e, (p, q), (r, s) in pieces[:-1] for x in (b, e - 1)]
        starts, lengths = zip(*ends)
        found = pieces[-1][0], min(starts), max(starts), max(lengths)
        return pieces[-1:], tuple(f(*pair) for f, pair in zip((max, min, max, max), zip(found, bounds or found)))

    def extend(effect: tuple | None, rows: Rows) -> tuple:
        # before the first timed frame: how often the earlier length is added, a way to add, the length once it is known
        early, way, known, pieces, bounds = effect or (0, 0, None, None, None)
        for at, duration in zip(rows["start_ns"], rows["duration_ns"], strict=True):
            if pieces is None and at < 0:
                early, way = (early + 1, way) if known is None else (early, way + known)
                known = duration if duration > 0 else known
                continue
            if pieces is None:
                pieces = [(0, None, (0, 1), (0, 0))]
            if bounds:
                if at > bounds[2] and duration > 0:
                    pieces, bounds = [(0, bounds[0], (at, 0), (duration, 0)), *timed(pieces, at, duration)], None
                    pieces = joined(pieces)
                    continue
                bounds = bounded(bounds, at, duration)
            if at >= 0:
                pieces = timed(pieces, at, duration)
            else:
                pieces = joined([(b, e, (p + r, q + s), (duration, 0) if duration > 0 else (r, s)) for b, e, (p, q), (r, s) in pieces])
            if len(pieces) > CLOCK_PIECES:
                pieces, bounds = given_up(pieces, bounds)
        return early, way, known, pieces, bounds

    def enter(effect: tuple, state: str) -> str | None:
        early, way, known, pieces, bounds = effect
        last, length = json.loads(state)
        last += early * length + way
        length = length if known is None else known
        if pieces is None:
            return json.dumps([last, length])
        if bounds and last < bounds[0]:
            return None
        return next(json.dumps([p + q * last, r + s * last]) for b, e, (p, q), (r, s) in pieces if last >= b and (e is None or last < e))

    return Machine(step, extend, enter)


def source_clock(frames: DataFrame, fallback_ns: int) -> DataFrame:
    """Start and duration of each decoded frame of an upload (``file``, ``n``), kept in decode order.

    A frame without a timestamp (negative) follows the one before by its duration; no frame starts before the one
    before it; an unknown duration (0) is the step from the frame before, else the stream's frame period.
    """
    narrow = frames.select("file", "n", "start_ns", "duration_ns")
    fields = [StructField("at_ns", LongType()), StructField("length_ns", LongType())]
    return fold_timeline(narrow, ["file"], ["n"], clock_machine(fallback_ns), fields)


def rate_convert(frames: DataFrame, num: int, den: int) -> DataFrame:
    """(file, house_frame, n): the source frame nearest to each house frame, the earlier on a tie.

    ``frames``: file, n, start_ns, duration_ns. A source frame lasts to half-way to the next one; the last one lasts
    its own duration; every file shows at least one frame. Each source frame computes the house frames it covers.
    """
    second = 1_000_000_000 * den
    risen = over_timeline(
        frames, ["file"], ["n"], at=running_max("start_ns"), _before=running_max("start_ns", before=True), _after=following_row("start_ns")
    )
    at, house = F.col("at"), lambda n: idiv(n * second, num)
    # the next frame starts no earlier than this one, so one round over the rows tells both neighbours
    next_at = F.when(F.col("_after").isNotNull(), F.greatest(at, F.col("_after.start_ns")))

    def shown_until(sum_of_starts: Column) -> Column:
        # House frames n with 2·start(n) no later than the sum of the neighbouring starts.
        half = idiv(sum_of_starts, 2) + 1
        return idiv(half * num + second - 1, second)

    end = at + F.col("duration_ns")
    guess = F.greatest(idiv(end * num, second) - 2, F.lit(0).cast("long"))
    inside = lambda n: F.when(house(n) + house(n + 1) <= 2 * end, 1).otherwise(0)
    until_end = guess + sum((inside(guess + k) for k in range(1, 5)), inside(guess))
    begin = F.coalesce(shown_until(F.col("_before") + at), F.lit(0).cast("long"))
    stop = F.coalesce(shown_until(next_at + at), until_end)
    stop = F.when(F.col("_after").isNull() & (begin == 0), F.greatest(stop, F.lit(1).cast("long"))).otherwise(stop)
    return (
        risen.select("file", "n", begin.alias("_begin"), stop.alias("_stop"))
        .filter("_stop > _begin")
        .select("file", "n", F.explode(F.sequence("_begin", F.col("_stop") - 1)).alias("house_frame"))
    )


def live_frames(outputs: DataFrame, frames: DataFrame, delay_frames: int, period_ns: int) -> DataFrame:
    """What a live channel shows: the frame nearest to its output time less the delay."""
    live = outputs.withColumn("position_ns", F.col("at_ns") - delay_frames * period_ns)
    return nearest(live, frames, ["camera"], "position_ns", "tai_ns")


def route_update(routes: DataFrame, updates: DataFrame, order: str) -> DataFrame:
    """Apply state changes that were made for the route as it still is; others are out of date and ignored."""
    key = ["route", "active", "domain", "flow", "sender"]
    newest = latest(updates, key, order).select(*key, F.col("state").alias("_state"))
    return routes.join(newest, key, "left").withColumn("state", F.coalesce("_state", "state")).drop("_state")
