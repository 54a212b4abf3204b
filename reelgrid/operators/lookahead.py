"""What the next grains of a channel need: frame pairs to interpolate and frames to decode ahead.

All of it is local to a channel's state: a few grains of at most two sources, as arrays. Nothing is shuffled. Lambdas
over nested arrays are interpreted node by node, so the grains of a batch of states are laid out as matrices instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.functions.timebase import idiv

# How far ahead pairs are asked for; the frames asked for and kept at most; the next clip's first frames.
PAIR_GRAINS = 8
PLAN_FRAMES = 8
KEPT_FRAMES = 2
NEXT_FRAMES = 6


FRAMES = "array<struct<camera:int,frame_ns:bigint>>"


def picked(position: np.ndarray, factor, period_ns: int, snap: float, repeat) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The frames shown at positions, numbered by the source's period: first, second, and whether it is between them."""
    rest = position % period_ns * factor
    lower = position // period_ns * factor + rest // period_ns
    phase = (rest % period_ns) / float(period_ns)
    between = (np.minimum(phase, 1.0 - phase) > snap) & np.logical_not(repeat)
    near = lower + (phase >= 0.5)
    return np.where(between, lower, near), np.where(between, lower + 1, near), between


def plain(values: pa.Array, instead) -> np.ndarray:
    return pc.fill_null(values, instead).to_numpy(zero_copy_only=False)


def steps(speed: np.ndarray, period_ns: int) -> np.ndarray:
    """How far a source moves in a grain, half away from zero."""
    if not np.isfinite(speed).all():
        raise ValueError("a speed is not finite")
    way = speed * float(period_ns)
    whole = np.trunc(way)
    whole += np.sign(way) * (np.abs(way - whole) >= 0.5)
    if not ((whole >= -(2.0**63)) & (whole < 2.0**63)).all():
        raise ValueError("a speed is too great")
    return whole.astype(np.int64)


def positions_after(position: pa.Array, speed: pa.Array, playing: pa.Array, grain: np.ndarray, last, period_ns: int) -> np.ndarray:
    """Where sources are some grains on, a row each; a paused one shows its own frame first, an unknown place is 0.

    ``last`` is the last grain that counts; a place up to it that 64 bits do not hold is an error, as in SQL.
    """
    known = plain(pc.and_(pc.is_valid(position), pc.is_valid(speed)), False)
    start, held = np.where(known, plain(position, 0), 0), np.where(plain(playing, False), 0, 1)
    step = steps(np.where(known, plain(speed, 0.0), 0.0), period_ns)
    # all places lie between the start and the last one
    pc.add_checked(pa.array(start), pc.multiply_checked(pa.array(step), pa.array(last - held)))
    at = start[:, None] + step[:, None] * (grain[None, :] - held[:, None])
    return np.where(known[:, None], np.maximum(at, 0), 0)


def as_lists(counts: np.ndarray, **values: np.ndarray | pa.Array) -> pa.Array:
    """A list of structs for each row, ``counts`` of them."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(v) for v in values.values()], names=list(values)))


def pair_demand(
    states: DataFrame, period_ns: int, snap: float, grains: int = PAIR_GRAINS, factor: int = 1, recorded: str | None = None
) -> DataFrame:
    """Distinct frame pairs the next grains interpolate between: first and last grain needing each.

    A paused state keeps its own pair to the end of the look-ahead. With ``recorded``, the column of the newest recorded
    instant (null: nothing is), only pairs whose second frame is recorded are asked for.
    """

    def pairs(position: pa.Array, speed: pa.Array, playing: pa.Array, newest: pa.Array) -> pa.Array:
        grain = np.arange(1, grains + 1)
        a, _, wanted = picked(positions_after(position, speed, playing, grain, grains, period_ns), factor, period_ns, snap, False)
        paused = ~plain(playing, True)
        last = np.where(paused[:, None] & (grain == 1), grains, grain)
        new = wanted.copy()
        for i in range(grains):
            for j in range(i + 1, grains):
                same = wanted[:, i] & wanted[:, j] & (a[:, i] == a[:, j])
                new[:, j] &= ~same
                last[:, i] = np.where(same, np.maximum(last[:, i], last[:, j]), last[:, i])
        if recorded:
            new &= plain(pc.is_valid(newest), False)[:, None] & ((a + 1) * (period_ns // factor) <= plain(newest, 0)[:, None])
        first = np.broadcast_to(grain, new.shape)
        return as_lists(new.sum(axis=1), a=a[new], first=first[new].astype(np.int32), last=last[new].astype(np.int32))

    asked = F.arrow_udf(pairs, "array<struct<a:bigint,first:int,last:int>>")
    newest = F.col(recorded).cast("bigint") if recorded else F.lit(0).cast("bigint")
    given = F.col("position_ns").cast("bigint"), F.col("speed").cast("double"), F.col("playing"), newest
    # an inner generator would filter by the size of its list, pushed down as a second computation of it
    each = states.select("state", asked(*given).alias("_pairs")).select("state", F.inline_outer("_pairs")).filter("a is not null")
    return each.select("state", "a", (F.col("a") + 1).alias("b"), "first", "last")


def opening(camera: Column, in_ns: Column, speed: Column, period_ns: int, snap: float, frames: int = NEXT_FRAMES) -> Column:
    """The first frames a clip shows from its IN, each once, as (camera, frame_ns)."""
    at = lambda g: in_ns + F.round(speed * F.lit(float(period_ns))).cast("long") * g
    half_up = lambda ns: F.when((ns % period_ns).cast("double") / float(period_ns) >= 0.5, 1).otherwise(0)
    places = F.transform(F.sequence(F.lit(0), F.lit(frames - 1)), at)
    nearest = F.transform(places, lambda ns: (idiv(ns, period_ns) + half_up(ns)) * period_ns)
    return F.transform(F.array_distinct(nearest), lambda ns: F.struct(camera.alias("camera"), ns.alias("frame_ns")))


class Sources:
    """The sources of a batch of states as flat arrays; ``state`` is the row that each belongs to, ``side`` its place."""

    def __init__(self, sources: pa.Array, period_ns: int, snap: float):
        counts = plain(pc.list_value_length(sources), 0)
        flat = sources.flatten()
        self.field = lambda name: flat.field(name)
        self.states, self.size = len(sources), len(flat)
        self.state = np.repeat(np.arange(self.states), counts)
        self.side = np.arange(self.size) - np.repeat(np.cumsum(counts) - counts, counts)
        self.factor, self.both = plain(self.field("factor"), 1).astype(np.int64), plain(self.field("both"), True)
        self.own_ns = period_ns // self.factor
        self.repeat = plain(pc.equal(self.field("motion"), "repeat"), True)
        # cameras as numbers, the lowest for an unknown one
        self.camera = plain(pc.cast(self.field("camera"), pa.int64()), NO_CAMERA)
        now = np.maximum(plain(self.field("position_ns"), 0), 0)
        self.a, self.b, self.between = picked(now, self.factor, period_ns, snap, self.repeat)


#: Stands for an unknown camera; cameras are integers of 32 bits.
NO_CAMERA = -(2**31) - 1


def first_of_each(states: int, state: np.ndarray, rank: np.ndarray, camera: np.ndarray, frame_ns: np.ndarray, limit: int | None) -> pa.Array:
    """The distinct frames of each state, by rank, at most ``limit``."""
    owner = state * 2**33 + (camera - NO_CAMERA)
    order = np.lexsort((rank, frame_ns, owner))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(owner[order]) != 0) | (np.diff(frame_ns[order]) != 0)
    kept = order[new]
    kept = kept[np.lexsort((rank[kept], state[kept]))]
    counts = np.bincount(state[kept], minlength=states)
    if limit is not None:
        place = np.arange(len(kept)) - np.repeat(np.cumsum(counts) - counts, counts)
        kept, counts = kept[place < limit], np.minimum(counts, limit)
    cameras = camera[kept]
    known = pa.array(np.where(cameras == NO_CAMERA, 0, cameras).astype(np.int32), mask=cameras == NO_CAMERA)
    return as_lists(counts, camera=known, frame_ns=frame_ns[kept])


def decode_plan(
    states: DataFrame, sources: Column, period_ns: int, snap: float, grains: int, following: Column | None = None,
    limit: int | None = PLAN_FRAMES, kept: int = KEPT_FRAMES,
) -> DataFrame:
    """Add ``plan`` and ``keep``, arrays of (camera, frame_ns), to channel states.

    ``sources`` are what the channel shows, two during a mix: camera, position_ns, speed, playing, motion, factor (source
    frames a grain), until_ns (OUT, or null), grains (its own look-ahead, or null) and both (whether a grain between two
    frames is decoded as such). The plan names the frames of the next grains, grain by grain and in each grain source by
    source, each once, none before 0 or after OUT and none that its source shows now; the ``following`` frames, those
    of the next clip, come after the first grain. ``keep`` are the frames shown now. ``limit`` and ``kept`` bound the
    two, as a decoder has so many slots.
    """

    def needed(given: pa.Array, after: pa.Array) -> pa.Array:
        src = Sources(given, period_ns, snap)
        own = plain(src.field("grains"), grains)
        grain = np.arange(1, max(grains, own.max(initial=0)) + 1)
        at = positions_after(src.field("position_ns"), src.field("speed"), src.field("playing"), grain, own, period_ns)
        column = lambda values: values[:, None]
        a, b, between = picked(at, column(src.factor), period_ns, snap, column(src.repeat))
        number = np.stack([a, b], axis=2)
        every = lambda values: values[:, None, None]
        frame_ns = number * every(src.own_ns)
        shown = every(src.both | ~src.between) & ((number == every(src.a)) | (every(src.between) & (number == every(src.b))))
        until = src.field("until_ns")
        inside = every(~plain(pc.is_valid(until), False)) | (frame_ns <= every(plain(until, 0)))
        soon = (column(own) >= grain) & ~(between & ~column(src.both))
        wanted = ~shown & (number >= 0) & inside & soon[:, :, None]
        # ranks: grain by grain, in it source by source, the following frames after the first grain
        counts = plain(pc.list_value_length(after), 0)
        clip = after.flatten()
        sides, wide = src.side.max(initial=0) + 2, max(2, counts.max(initial=0))
        rank = (grain[None, :, None] * sides + every(src.side)) * wide + np.arange(2)
        nth = np.arange(len(clip)) - np.repeat(np.cumsum(counts) - counts, counts)
        whole = lambda values: np.broadcast_to(every(values), wanted.shape)[wanted]
        return first_of_each(
            src.states,
            np.concatenate([whole(src.state), np.repeat(np.arange(src.states), counts)]),
            np.concatenate([rank[wanted], (2 * sides - 1) * wide + nth]),
            np.concatenate([whole(src.camera), plain(pc.cast(clip.field("camera"), pa.int64()), NO_CAMERA)]),
            np.concatenate([frame_ns[wanted], plain(clip.field("frame_ns"), 0)]),
            limit,
        )

    def shown_now(given: pa.Array) -> pa.Array:
        src = Sources(given, period_ns, snap)
        number = np.stack([src.a, src.b], axis=1)
        held = np.stack([~src.between | src.both, src.between & src.both], axis=1)
        of = lambda values: np.broadcast_to(values[:, None], held.shape)[held]
        rank = src.side[:, None] * 2 + np.arange(2)
        return first_of_each(src.states, of(src.state), rank[held], of(src.camera), (number * src.own_ns[:, None])[held], kept)

    after = F.array().cast(FRAMES) if following is None else F.coalesce(following.cast(FRAMES), F.array().cast(FRAMES))
    with_sources = states.withColumns({"_sources": sources, "_after": after})
    plan, keep = F.arrow_udf(needed, FRAMES), F.arrow_udf(shown_now, FRAMES)
    return with_sources.withColumns({"plan": plan("_sources", "_after"), "keep": keep("_sources")}).drop("_sources", "_after")


def source(camera, position_ns, speed, playing, motion, factor=1, until_ns=None, grains=None, both=True) -> Column:
    """One source of :func:`decode_plan`."""
    column = lambda v, kind: (v if isinstance(v, Column) else F.lit(v)).cast(kind)
    given = {"camera": (camera, "int"), "position_ns": (position_ns, "bigint"), "speed": (speed, "double"), "playing": (playing, "boolean"),
             "motion": (motion, "string"), "factor": (factor, "int"), "until_ns": (until_ns, "bigint"), "grains": (grains, "int"),
             "both": (both, "boolean")}
    return F.struct(*[column(v, kind).alias(name) for name, (v, kind) in given.items()])


def frame_demand(states: DataFrame) -> DataFrame:
    """The frames of planned states, one row each with its place in the plan."""
    # outer for the same reason as in pair_demand
    placed = states.select("state", F.posexplode_outer("plan").alias("_at", "_frame")).filter("_at is not null")
    return placed.select("state", (F.col("_at") + 1).alias("place"), "_frame.camera", "_frame.frame_ns")
