"""As-of lookups: for every probe, the recorded row at or before it, and the one after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.plans.ordered import last_value, next_value, over_timeline


def asof(
    probes: DataFrame,
    frames: DataFrame,
    keys: list[str],
    probe_time: str,
    frame_time: str,
    columns: list[str] | None = None,
    before: str | None = "before",
    after: str | None = "after",
    in_order: bool = False,
) -> DataFrame:
    """Each probe with ``before`` (latest row not later than it) and ``after`` (first later row) as structs.

    Of frames equal in (keys, frame_time) the one whose ``columns`` are the greatest counts, compared in the order
    given, so that reruns agree. With ``in_order`` these columns go on where the time ends: the row before is still the
    greatest of its instant, but the row after is the least. Probes and frames are merged into one timeline, so a camera or an instant that holds
    most of the probes is split like any other part of it.
    """
    row = F.struct(*[F.col(c) for c in dict.fromkeys([frame_time, *(columns or [])])])
    probe = F.struct(*probes.columns)
    left = probes.select(*keys, F.col(probe_time).alias("_at"), F.lit(1).alias("_side"), probe.alias("_probe"))
    right = frames.select(*keys, F.col(frame_time).alias("_at"), F.lit(0).alias("_side"), row.alias("_frame"))
    merged = left.unionByName(right, allowMissingColumns=True)
    found = {}
    if before:
        found[before] = last_value("_frame")
    if after:
        found[after] = next_value("_frame")
    # with the instant alone, equal rows cannot be told apart
    ties = "_frame" if len(right.schema["_frame"].dataType) > 1 else None
    seen = over_timeline(merged, keys, ["_at", "_side"], [F.xxhash64("_probe")], ties, in_order, **found)
    return seen.filter("_side = 1").select("_probe.*", *found)


def nearest_of(at: Column, before: Column, after: Column, time: str) -> Column:
    """The nearer of two neighbours, the earlier one on a tie; the only one at either end of the timeline."""
    gap_before = at - before[time]
    gap_after = after[time] - at
    return F.when(before.isNull() | (gap_after < gap_before), F.coalesce(after, before)).otherwise(before)


def nearest(
    probes: DataFrame,
    frames: DataFrame,
    keys: list[str],
    probe_time: str,
    frame_time: str,
    columns: list[str] | None = None,
    name: str = "frame",
    in_order: bool = False,
) -> DataFrame:
    """Each probe with the nearest row as struct ``name`` (null where a key has no rows)."""
    both = asof(probes, frames, keys, probe_time, frame_time, columns, "_b", "_a", in_order)
    return both.withColumn(
        name, nearest_of(F.col(probe_time), F.col("_b"), F.col("_a"), frame_time)
    ).drop("_b", "_a")
