"""The output timeline: speeds, positions, source picks, look-ahead demands, playlists and shots."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField

from reelgrid.functions.playout import (
    DEFAULT_CUT_AUDIO_FRAMES,
    MIN_CLIP_SPEED,
    clip_remaining,
    transition_frames,
)
from reelgrid.functions.timebase import idiv
from reelgrid.plans.asof import nearest
from reelgrid.plans.fold import Machine, Rows, fold_timeline
from reelgrid.plans.greedy import greedy_groups
from reelgrid.plans.lines import Line
from reelgrid.plans.ordered import (
    following_row,
    last_value,
    next_value,
    over_timeline,
    previous_row,
    running,
    running_count,
    running_sum,
    spread,
)

def _ramp_machine(ramp: int) -> Machine:
    """Where each command's ramp starts from: an affine function of where the one before did."""

    def reached(origin: float, target: float, grains: int) -> float:
        return origin + (target - origin) * (min(grains, ramp) / ramp if ramp > 0 else 1.0)

    def step(state: str | None, rows: Rows) -> tuple[Rows, str]:
        origin, target, since = json.loads(state) if state else (1.0, 1.0, 0)
        starts = []
        for to, n in zip(rows["_to"], rows["_n"], strict=True):
            origin = reached(origin, target, n - since)
            target, since = to, n
            starts.append(origin)
        return {"_from": starts, "_since": rows["_n"]}, json.dumps([origin, target, since])

    def extend(effect: tuple | None, rows: Rows) -> tuple:
        for to, n in zip(rows["_to"], rows["_n"], strict=True):
            if effect is None:
                effect = n, 1.0, 0.0, to, n
                continue
            first, slope, shift, target, since = effect
            effect = first, reached(slope, 0.0, n - since), reached(shift, target, n - since), to, n
        return effect

    def enter(effect: tuple, state: str) -> str:
        first, slope, shift, target, since = effect
        origin, goal, begun = json.loads(state)
        return json.dumps([slope * reached(origin, goal, first - begun) + shift, target, since])

    return Machine(step, extend, enter)


def speed_ramp(ticks: DataFrame, ramp: int) -> DataFrame:
    """Speed applied on each grain of a channel; a grain with a ``target`` starts a linear ramp to it.

    Within a command the speed has a closed form in the grains since it. Only where a command starts from depends on
    the one before, so the commands alone are folded, meet their own grain, and are carried on from there.
    """
    wanted = F.when(F.col("target").isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(2.0), F.col("target"))))
    cut = spread(ticks.withColumn("_to", wanted), ["channel"], ["grain"])
    counted = running(
        cut,
        ["channel"],
        ["grain"],
        _n=running_count(),
        _target=last_value("_to"),
    )
    commands = counted.filter("_to is not null").select("channel", "grain", "_to", "_n")

    fields = [StructField("_from", DoubleType()), StructField("_since", LongType())]
    started = fold_timeline(commands, ["channel"], ["grain"], _ramp_machine(ramp), fields)
    begun = F.when(F.col("_since").isNotNull(), F.struct("_from", "_since"))
    met = counted.join(started, ["channel", "grain"], "left").withColumn("_begun", begun).drop("_from", "_since")
    carried = running(met, ["channel"], ["grain"], _last=last_value("_begun")).select("*", "_last._from", "_last._since")
    done = F.least(F.col("_n") - F.col("_since") + 1, F.lit(ramp)) / F.lit(max(1, ramp))
    speed = F.when(F.col("_from").isNull(), 1.0).otherwise(
        F.when(F.lit(ramp) == 0, F.col("_target")).otherwise(F.col("_from") + (F.col("_target") - F.col("_from")) * done)
    )
    return carried.select(*ticks.columns, speed.alias("speed"))


def position_track(ticks: DataFrame, period_ns: int, start_ns: int) -> DataFrame:
    """Position after each grain: the start plus the rounded steps so far."""
    step = F.round(F.col("speed") * F.lit(float(period_ns))).cast("long")
    moved = over_timeline(ticks, ["channel"], ["grain"], _moved=running_sum(step))
    return moved.withColumn("position_ns", F.col("_moved") + start_ns).drop("_moved")


def with_pick(
    rows: DataFrame, name: str, position: str, period_ns: int, num: Column, den: Column, snap: float, motion: Column
) -> DataFrame:
    """Add the frames shown at a position: kind, numbers a and b, phase between them, and whether it snapped.

    There are ``num / den`` source frames (at least one) per house period. Frame number and rest are taken in whole
    nanoseconds, so the phase keeps its precision at today's instants. The parts are separate projections, so each is
    computed once per row.
    """
    one = F.lit(1).cast("long")
    few = num < den
    part = lambda p: f"_{name}_{p}"
    num_col, span, lower, rest, phase = (F.col(part(p)) for p in ("num", "span", "lower", "rest", "phase"))
    staged = (
        rows.withColumns(
            {
                part("num"): F.when(few, one).otherwise(num.cast("long")),
                part("span"): F.when(few, one).otherwise(den.cast("long")) * F.lit(period_ns).cast("long"),
            }
        )
        # position = span·n + rest; rest·num/span is the frame in the span and its phase.
        .withColumn(part("rest"), (F.col(position) % span) * num_col)
        .withColumn(part("lower"), idiv(F.col(position), span) * num_col + idiv(rest, span))
        .withColumn(part("phase"), (rest % span).cast("double") / span.cast("double"))
    )
    near = lower + F.when(phase >= 0.5, 1).otherwise(0)
    distance = F.least(phase, 1.0 - phase)
    snapped = distance <= snap
    repeat = motion == "repeat"
    a = F.when(snapped | (repeat & (phase >= 0.5)), near).otherwise(lower)
    between = ~snapped & ~repeat
    kind = (
        F.when(snapped & (num_col * period_ns == span) & (distance < 1e-6), "exact")
        .when(snapped | repeat, "repeat")
        .when(motion == "blend", "blend")
        .otherwise("interpolate")
    )
    return staged.withColumn(
        name,
        F.struct(
            kind.alias("kind"),
            a.alias("a"),
            F.when(between, lower + 1).otherwise(a).alias("b"),
            F.when(between, phase).otherwise(0.0).alias("phase"),
            snapped.alias("snapped"),
        ),
    ).drop(*[part(p) for p in ("num", "span", "lower", "rest", "phase")])


def motion_effective(motion: Column, kind: Column, has_flow: Column, mixing: Column) -> Column:
    """How a grain's picture is made: a mix, one frame, an interpolation with its flow, or a blend."""
    single = kind.isin("exact", "repeat")
    return (
        F.when(mixing, "mix").when(single, "repeat").when((motion == "interpolate") & has_flow, "interpolate").otherwise("blend")
    )


def audio_plan(ticks: DataFrame, house_ns: int) -> DataFrame:
    """Where each grain reads its sound, and the gains of its two-grain fades.

    ``silent`` grains fade out, others fade in; the fade counter walks between 0 and 2. It is known wherever two
    grains in a row agree, and strictly alternates after that. A channel that stands ``still`` goes on reading one
    house frame further while it fades out.
    """
    keys, order = ["channel"], ["grain"]
    rounded = F.expr(f"(position_ns + {house_ns // 2}) div {house_ns} * {house_ns}")
    cut = spread(ticks, keys, order)
    was = running(cut, keys, order, _was=previous_row("silent"), _n=running_count())
    silent, before = F.col("silent"), F.col("_was.silent")
    doubled = was.withColumn("_double", F.when(silent == before, silent).when(before.isNull() & ~silent, False))
    known = running(doubled, keys, order, again=True, _known=last_value("_double"))
    low = F.when(F.coalesce("_known", F.lit(False)), 1).otherwise(0)
    counted = known.withColumn("_after", low + F.when(silent, 1).otherwise(0))
    faded = running(counted, keys, order, again=True, _prior=previous_row("_after"))
    held_before = F.coalesce(F.col("_prior._after"), F.lit(0))
    holds = F.col("still") & (held_before < 2) & F.col("_prior").isNotNull()
    held = faded.withColumn("fade", held_before).withColumn("_holds", holds)
    base = F.when(~F.col("_holds"), F.struct(rounded.alias("at"), F.col("_n").alias("n")))
    placed = running(held, keys, order, again=True, _base=last_value(base))
    start = F.when(silent, F.when(F.col("fade") < 2, 1 - F.col("fade") / 2).otherwise(0.0)).otherwise(
        F.when(F.col("fade") > 0, (2 - F.col("fade")) / 2).otherwise(1.0)
    )
    end = F.when(silent, F.when(F.col("fade") < 2, 1 - (F.col("fade") + 1) / 2).otherwise(0.0)).otherwise(
        F.when(F.col("fade") > 0, (3 - F.col("fade")) / 2).otherwise(1.0)
    )
    audio = F.col("_base.at") + (F.col("_n") - F.col("_base.n")) * house_ns
    return placed.select(*ticks.columns, "fade", audio.alias("audio_ns"), start.alias("gain_from"), end.alias("gain_to"))


def grid_resyncs(grains: DataFrame) -> DataFrame:
    """Where a channel's output left its grid, and by how much."""
    seen = over_timeline(grains, ["channel"], ["tai_ns"], _was=previous_row("grain"))
    jump = F.col("grain") - F.col("_was.grain") - 1
    return seen.withColumn("jump", jump).filter("jump <> 0").drop("_was")


def log_limit(events: DataFrame, keys: list[str], interval_ns: int) -> DataFrame:
    """The lines written for a repeated event: the first at once, then one per interval with the count since."""
    grouped = greedy_groups(events, keys, "tai_ns", interval_ns, inclusive=True)
    per = grouped.groupBy(*keys, F.col("group_first").alias("line_ns")).agg(F.count("*").alias("_all"))
    # A line counts the events after the line before and itself; others of its own instant wait for the next one.
    rest = over_timeline(per, keys, ["line_ns"], _was=previous_row("_all"))
    return rest.select(*keys, "line_ns", F.coalesce(F.col("_was._all"), F.lit(1).cast("long")).alias("events"))


def _listed(entries: DataFrame) -> DataFrame:
    """Entries (with ``present``) cut by playlist and position, each with the first and next present entry."""
    here = F.when(F.col("present"), F.col("position"))
    cut = spread(entries, ["playlist"], ["position"])
    later = running(cut, ["playlist"], ["position"], _later=next_value(here))
    first = entries.groupBy("playlist").agg(F.min(here).alias("_first"))
    return later.join(first, "playlist", "left")


def end_action(entries: DataFrame) -> DataFrame:
    """What happens at the OUT of each playable entry: action, next entry and whether it plays on.

    In a looped list (``loop``) the last playable entry's freeze or black wraps to the first entry.
    """
    listed = _listed(entries).filter("present")
    wraps = F.col("loop") & F.col("end_action").isin("freeze", "black") & F.col("_later").isNull()
    action = F.when(wraps, "next").otherwise(F.col("end_action"))
    following = F.coalesce("_later", F.when(F.col("loop"), F.col("_first")))
    on = action == "next"
    return listed.select(
        "playlist",
        "position",
        action.alias("action"),
        F.when(on, following).alias("next_position"),
        F.when(on, F.col("auto_advance") | wraps).otherwise(F.lit(False)).alias("plays_on"),
    )


def idle_next(entries: DataFrame) -> DataFrame:
    """The entry an idle playlist plays after each entry: the next present one, wrapping around; null when none is."""
    return _listed(entries).select("playlist", "position", F.coalesce("_later", "_first").alias("next_position"))


def _held(frames: int, plan: int) -> int:
    """What a join may take at most of the grains before it, however many these are."""
    return max(1, min(plan, max(1, frames - DEFAULT_CUT_AUDIO_FRAMES)))


def _join_step(state: str | None, rows: Rows) -> tuple[Rows, str]:
    # The state is the grains the entry before still has when no join is running.
    free = int(state) if state else None
    lengths, overlaps = [], []
    for grains, frames, plan in zip(rows["_grains"], rows["_frames"], rows["_plan"], strict=True):
        if free is None:
            overlap, grains = 0, grains - 1
            free = grains
        else:
            overlap = min(plan, max(1, min(frames - DEFAULT_CUT_AUDIO_FRAMES, free)), free)
            free = grains - max(1, min(free, _held(frames, plan)))
        lengths.append(grains)
        overlaps.append(overlap)
    return {"grains": lengths, "overlap": overlaps}, str(free)


def _join_extend(effect: Line | None, rows: Rows) -> Line:
    line = effect or Line()
    for grains, frames, plan in zip(rows["_grains"], rows["_frames"], rows["_plan"], strict=True):
        line = line.then(Line(-1, grains, grains - _held(frames, plan), grains - 1))
    return line


#: Joins of a list: the grains an entry has left are a clamped line of those the one before had.
JOINS = Machine(_join_step, _join_extend, lambda effect, state: str(int(effect(int(state)))))


def playlist_unroll(entries: DataFrame, period_ns: int, passes: int = 1) -> DataFrame:
    """Plays of each playlist on its output timeline, in grains from its start.

    ``entries``: playlist, position, clip_id, in_ns, out_ns, speed, end_action, plan fields, present, loop. The list
    is cut at the first entry that does not play on; a looped list without such an entry repeats for ``passes``.
    The very first entry shows IN plus one step on its first grain, every later one IN itself. A join starts when the
    grains left reach its length, which is held to the incoming entry's length less two and to what is left.
    """
    present = entries.filter("present")
    cut = running(
        spread(present, ["playlist"], ["position"]), ["playlist"], ["position"], _next=following_row("position")
    )
    last = F.col("_next").isNull()
    wraps = F.col("loop") & last & F.col("end_action").isin("freeze", "black", "next")
    on = wraps | ((F.col("end_action") == "next") & F.col("auto_advance") & ~last)
    auto = on & ((F.col("end_action") != "next") | F.col("auto_advance"))
    flagged = cut.withColumn("_on", auto)
    stopped = running(
        flagged, ["playlist"], ["position"], again=True, _stops=running_count(~F.col("_on"), before=True)
    ).filter("_stops = 0")
    endless = stopped.groupBy("playlist").agg(F.every("_on").alias("_endless"))
    repeats = F.when(F.col("_endless"), passes).otherwise(1)
    played = (
        stopped.join(endless, "playlist")
        .withColumn("pass", F.explode(F.sequence(F.lit(1), repeats)))
        .withColumn("_plan", transition_frames("transition", "transition_frames", "audio_frames")["length"])
    )
    length = F.col("out_ns") - F.col("in_ns")
    step = F.round(F.col("speed") * F.lit(float(period_ns))).cast("long")
    rows = played.select(
        "playlist",
        "pass",
        "position",
        F.ceil(length / step).cast("long").alias("_grains"),
        F.floor(length / (F.greatest(F.lit(MIN_CLIP_SPEED), "speed") * period_ns)).cast("long").alias("_frames"),
        F.col("_plan").cast("long").alias("_plan"),
        "clip_id",
        "end_action",
        "_on",
    )

    fields = [StructField(n, LongType()) for n in ("grains", "overlap")]
    keys, order = ["playlist"], ["pass", "position"]
    detail = ["clip_id", "end_action", "_on"]
    joined = fold_timeline(rows, keys, order, JOINS, fields, keep=detail, keep_chunk=True)
    ends = running(joined, keys, order, _end=running_sum(F.col("grains") - F.col("overlap")))
    placed = ends.withColumn("start_grain", F.col("_end") - F.col("grains"))
    outcome = F.when(F.col("_on"), "next").when(F.col("end_action") == "next", "cued").otherwise(F.col("end_action"))
    return placed.select(
        "playlist", "pass", "position", "clip_id", "start_grain", "grains", "overlap", outcome.alias("outcome")
    )


def overlap_ns(length: Column, period_ns: int) -> Column:
    """Time a join takes off a list: its length, held to the incoming entry's less the default cut crossfade."""
    planned = transition_frames("transition", "transition_frames", "audio_frames")["length"].cast("long") * period_ns
    held = F.greatest(F.lit(period_ns).cast("long"), length - DEFAULT_CUT_AUDIO_FRAMES * period_ns)
    return F.when(planned > 0, F.least(planned, held)).otherwise(F.lit(0).cast("long"))


def playlist_remaining(entries: DataFrame, period_ns: int) -> DataFrame:
    """Time left in a playlist for each entry taken as the current one, ``left_ns`` being left of that entry.

    Counts to the first entry that does not end with ``next``; deleted clips are skipped; null where a loop is met.
    """
    keys, order = ["playlist"], ["position"]
    length = F.when(F.col("present"), clip_remaining("in_ns", "out_ns", "speed"))
    cut = spread(entries.withColumn("_len", length), keys, order)
    joined = running(cut, keys, order, _was=previous_row("auto_advance"))
    overlap = F.when(F.col("_was.auto_advance"), overlap_ns(F.col("_len"), period_ns)).otherwise(F.lit(0).cast("long"))
    gained = F.coalesce(F.col("_len") - overlap, F.lit(0).cast("long"))
    summed = running(joined, keys, order, again=True, _sum=running_sum(gained))
    stop = F.when(F.col("present") & (F.col("end_action") != "next"), F.struct("_sum", "end_action"))
    stops = running(summed, keys, order, again=True, _stop=next_value(stop))
    whole = summed.groupBy("playlist").agg(F.max_by("_sum", "position").alias("_whole"))
    own = F.col("end_action") != "next"
    until = F.when(own, F.col("_sum")).otherwise(F.coalesce(F.col("_stop._sum"), "_whole"))
    action = F.when(own, F.col("end_action")).otherwise(F.col("_stop.end_action"))
    remaining = F.when(~F.coalesce(action == "loop", F.lit(False)), F.col("left_ns") + until - F.col("_sum"))
    return stops.join(whole, "playlist").select("playlist", "position", remaining.alias("remaining_ns"))


def playlist_duration(entries: DataFrame, period_ns: int) -> DataFrame:
    """Playing time of each whole list: existing clips at their speed less the joins between entries that play on."""
    keys, order = ["playlist"], ["position"]
    rate = F.when(F.abs("speed") > 0.001, F.abs("speed")).otherwise(1.0)
    length = F.greatest(F.col("out_ns") - F.col("in_ns"), F.lit(0)).cast("double") / rate
    joined = over_timeline(entries, keys, order, _was=previous_row("auto_advance", "end_action"))
    plan = transition_frames("transition", "transition_frames", "audio_frames")["length"].cast("double") * period_ns
    held = F.greatest(F.lit(float(period_ns)), F.col("_len") - float(DEFAULT_CUT_AUDIO_FRAMES * period_ns))
    on = F.coalesce(F.col("_was.auto_advance") & (F.col("_was.end_action") == "next"), F.lit(False))
    overlap = F.when(on & (plan > 0), F.least(plan, held)).otherwise(0.0)
    return (
        joined.withColumn("_len", length)
        .groupBy("playlist")
        .agg(F.coalesce(F.sum(F.when(F.col("present"), F.col("_len") - overlap)), F.lit(0.0)).alias("duration_ns"))
    )


def transition_start(entries: DataFrame, period_ns: int) -> DataFrame:
    """For each entry that plays on: the grain of it on which the join starts, and the join's lengths."""
    plan = transition_frames("transition", "transition_frames", "audio_frames")
    span = F.col("out_ns") - F.col("in_ns")
    fits = F.floor(span / (F.greatest(F.lit(MIN_CLIP_SPEED), "speed") * period_ns)).cast("long") - DEFAULT_CUT_AUDIO_FRAMES
    ready = entries.filter("present").withColumn("_plan", plan).withColumn("_fits", fits)
    cut = spread(ready, ["playlist"], ["position"])
    paired = running(cut, ["playlist"], ["position"], _in=following_row("position", "_plan", "_fits"))
    grains = F.ceil(span / (F.col("speed") * period_ns)).cast("long")
    most = F.greatest(F.lit(1).cast("long"), F.least(F.col("_in._fits"), F.col("_grains")))
    video = F.least(F.col("_in._plan.video").cast("long"), most)
    audio = F.least(F.col("_in._plan.audio").cast("long"), most)
    joins = (
        paired.filter("end_action = 'next' and auto_advance and _in is not null")
        .withColumn("_grains", grains)
        .withColumn("video_frames", video)
        .withColumn("audio_frames", audio)
        .withColumn("_length", F.greatest("video_frames", "audio_frames"))
        .filter("_length > 0")
    )
    step = F.round(F.col("speed") * F.lit(float(period_ns))).cast("long")
    grain = F.col("_grains") - F.col("_length")
    return joins.select(
        "playlist", "position", F.col("_in.position").alias("next_position"), "video_frames", "audio_frames",
        grain.alias("start_grain"), (F.col("in_ns") + grain * step).alias("start_ns"),
    )


def shot_states(clicks: DataFrame, play_first: bool = False) -> DataFrame:
    """State of the clicked shot after each click; another shot starts over."""
    keys, order = ["channel"], ["grain"]
    cut = spread(clicks, keys, order)
    seen = running(cut, keys, order, _n=running_count(), _was=previous_row("shot"))
    new = F.coalesce(F.col("_was.shot") != F.col("shot"), F.lit(True))
    started = running(seen, keys, order, again=True, _start=last_value(F.when(new, F.col("_n"))))
    nth = F.col("_n") - F.col("_start") + (2 if play_first else 1)
    state = F.when(nth == 1, "cued").when(nth % 2 == 0, "playing").otherwise("paused")
    return started.select(*clicks.columns, state.alias("state"))


def idle_pictures(ticks: DataFrame, frames: DataFrame) -> DataFrame:
    """What an output shows: its frame, or by its ``idle`` mode the last one, black, or the live frame."""
    held = over_timeline(ticks, ["channel"], ["grain"], _last=last_value("frame_id"))
    live = nearest(
        held.filter("frame_id is null and idle = 'live'"), frames, ["camera"], "tai_ns", "tai_ns", ["event_id"], "_live"
    ).select("channel", "grain", F.col("_live.event_id").alias("_live"))
    shown = F.coalesce("frame_id", F.when(F.col("idle") == "last", F.col("_last")), "_live")
    kind = (
        F.when(F.col("frame_id").isNotNull(), "frame").when(shown.isNull(), "black").otherwise(F.col("idle"))
    )
    return held.join(live, ["channel", "grain"], "left").select(
        "channel", "grain", shown.alias("shown_id"), kind.alias("kind")
    )


def keep_entry(playing: DataFrame, entries: DataFrame) -> DataFrame:
    """After an edit: the same clip nearest the channel's old place, else the same place within the list.

    ``playing``: channel, playlist, position, clip_id.
    """
    size = entries.groupBy("playlist").agg(F.count("*").alias("_size"))
    places = entries.select("playlist", "clip_id", F.col("position").alias("there"))
    found = nearest(playing, places, ["playlist", "clip_id"], "position", "there", name="_best")
    last = F.coalesce("_size", F.lit(0)) - 1
    place = F.coalesce("_best.there", F.least(F.col("position"), last))
    return found.join(size, "playlist", "left").select("channel", "playlist", place.alias("kept"))
