"""Ordered computations per key that do not depend on how large a key is.

A window partitioned by camera alone puts a whole camera into one task. Here the rows are range-partitioned by
(keys, order), so each task holds an even, contiguous slice ("chunk") of the timeline whatever the distribution
of keys or times. Windows run inside a chunk; one small aggregate row per (key, chunk) carries the state of the
chunks before (or after) into it. All functions offered compose that way, so the results are exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.plans.session import pinned, pinned_table

CHUNK = "_chunk"


@dataclass(frozen=True)
class Running:
    """A running value: ``kind`` is one of sum, max, min, last, next; ``before`` leaves out the current row."""

    kind: str
    value: Column
    before: bool = False


def running_sum(value, before=False) -> Running:
    return Running("sum", _col(value), before)


def running_count(condition=None, before=False) -> Running:
    value = F.lit(1) if condition is None else F.when(condition, 1).otherwise(0)
    return Running("sum", value.cast("long"), before)


def running_max(value, before=False) -> Running:
    return Running("max", _col(value), before)


def running_min(value, before=False) -> Running:
    return Running("min", _col(value), before)


def last_value(value, before=False) -> Running:
    """The latest value that is not null."""
    return Running("last", _col(value), before)


def next_value(value) -> Running:
    """The first value after the current row that is not null."""
    return Running("next", _col(value), True)


def previous_row(*columns) -> Running:
    """The row before, as a struct (null on the first row of a key)."""
    return Running("last", F.struct(*columns), True)


def following_row(*columns) -> Running:
    """The row after, as a struct (null on the last row of a key)."""
    return Running("next", F.struct(*columns), True)


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def spread(
    df: DataFrame, keys: list[str], order: list[str], tiebreak: list[Column] | None = None, walk: bool = False
) -> DataFrame:
    """Cut the rows into balanced contiguous chunks of (keys, order) and pin the cut.

    ``tiebreak`` may split rows that are equal in (keys, order) over several chunks. The pin makes every later
    reader of the chunk number see the same cut, also after an executor is lost. ``walk`` keeps each chunk as one
    partition in order, for code that walks it.
    """
    bounds = [*map(F.col, keys), *map(F.col, order), *(tiebreak or [])]
    cut = df.repartitionByRange(chunk_count(df), *bounds)
    if walk:
        return pinned(cut.sortWithinPartitions(*keys, *order).withColumn(CHUNK, F.spark_partition_id()))
    return pinned_table(cut.withColumn(CHUNK, F.spark_partition_id()))


def chunk_count(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running(
    df: DataFrame, keys: list[str], order: list[str], again: bool = False, ties: str | None = None, in_order: bool = False, **outputs: Running
) -> DataFrame:
    """Add running values to rows that :func:`spread` cut; ``keys`` must not be null.

    ``order`` must be a total order within a key as far as the chosen functions can tell; or else ``ties`` is a column
    by which, of the rows of one place, the greatest counts for last and next values alike (``order`` is then whole
    numbers), or with ``in_order`` the greatest for last values and the least for next ones. The rows are placed with one chunk per partition, which a hash of the chunk number would not give;
    ``again`` says that an earlier call placed them, so a further round needs no shuffle.

    A chunk is contiguous in (keys, order), so only its first key can have rows in earlier chunks and only its last
    key in later ones. The carried states are therefore at most two rows per chunk, which is what is broadcast.
    """
    parts = [*keys, CHUNK]
    tied = [ties] if ties else []
    forward = Window.partitionBy(*parts).orderBy(*order, *tied)
    backward = Window.partitionBy(*parts).orderBy(*[F.desc(c) for c in order], *(map(F.desc, tied) if in_order else tied))
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    position = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    first, last = F.min_by, F.max_by
    if ties:
        # the nearest place, then the greatest there: the order is turned round for the first place
        first = lambda value, known: F.max_by(value, F.when(known.isNotNull(), F.struct(*[F.bitwise_not(c) for c in order], ties)))
        last = lambda value, known: F.max_by(value, F.when(known.isNotNull(), F.struct(*order, ties)))
    if ties and in_order:
        first = lambda value, known: F.min_by(value, F.when(known.isNotNull(), F.struct(*order, ties)))

    inside, summary, carry, combined = {}, [], [], {}
    for name, run in outputs.items():
        mine, theirs = f"_in_{name}", f"_carry_{name}"
        frame = (backward if run.kind == "next" else forward).rowsBetween(
            Window.unboundedPreceding, -1 if run.before else 0
        )
        known = F.when(run.value.isNotNull(), position)
        if run.kind == "sum":
            inside[mine] = F.sum(run.value).over(frame)
            summary.append(F.sum(run.value).alias(theirs))
            carry.append(F.sum(theirs).over(earlier).alias(theirs))
            zero = F.lit(0)
            combined[name] = F.coalesce(F.col(mine), zero) + F.coalesce(F.col(theirs), zero)
        elif run.kind in ("max", "min"):
            fold, pick = (F.max, F.greatest) if run.kind == "max" else (F.min, F.least)
            inside[mine] = fold(run.value).over(frame)
            summary.append(fold(run.value).alias(theirs))
            carry.append(fold(theirs).over(earlier).alias(theirs))
            combined[name] = pick(F.col(mine), F.col(theirs))
        else:
            inside[mine] = F.last(run.value, ignorenulls=True).over(frame)
            edge = first if run.kind == "next" else last
            summary.append(edge(run.value, known).alias(theirs))
            side = later if run.kind == "next" else earlier
            carry.append(F.last(theirs, ignorenulls=True).over(side).alias(theirs))
            combined[name] = F.coalesce(F.col(mine), F.col(theirs))

    chunks = F.count("*").over(Window.partitionBy(*keys)) if keys else F.lit(2)
    carried = (
        df.groupBy(*parts)
        .agg(*summary)
        .select(*parts, *carry, chunks.alias("_chunks"))
        .filter("_chunks > 1")
        .drop("_chunks")
    )
    placed = df if again else df.repartitionById(chunk_count(df), F.col(CHUNK))
    return (
        placed.withColumns(inside)
        .join(F.broadcast(carried), parts, "left")
        .withColumns(combined)
        .drop(*inside, *[f"_carry_{name}" for name in outputs])
    )


def over_timeline(
    df: DataFrame, keys: list[str], order: list[str], tiebreak: list[Column] | None = None, ties: str | None = None, in_order: bool = False, **outputs: Running
) -> DataFrame:
    """:func:`spread` and :func:`running` in one step, without the chunk column."""
    return running(spread(df, keys, order, tiebreak), keys, order, ties=ties, in_order=in_order, **outputs).drop(CHUNK)
