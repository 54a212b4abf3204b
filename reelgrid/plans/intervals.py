"""Closed intervals on the timeline: coverage tests and overlap joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.plans.ordered import over_timeline, running_max


def touched(
    spans: DataFrame,
    ranges: DataFrame,
    keys: list[str],
    first: str,
    last: str,
    begin: str = "begin_ns",
    end: str = "end_ns",
    name: str = "touched",
) -> DataFrame:
    """Flag the spans ``[first, last]`` that any range ``[begin, end]`` overlaps.

    A span is touched exactly when, among the ranges that begin no later than its last instant, the greatest end
    reaches its first instant: one running maximum over the merged timeline, and never a list of pairs.
    """
    span = F.struct(*spans.columns)
    # Many ranges may begin together; only the longest of them matters, so they are reduced before the shuffle.
    reach = (
        ranges.select(
            *keys, F.least(begin, end).alias("_at"), F.greatest(begin, end).alias("_reach")
        )
        .groupBy(*keys, "_at")
        .agg(F.max("_reach").alias("_reach"))
        .withColumn("_side", F.lit(0))
    )
    merged = spans.select(*keys, F.col(last).alias("_at"), F.lit(1).alias("_side"), span.alias("_span")).unionByName(
        reach, allowMissingColumns=True
    )
    marked = over_timeline(merged, keys, ["_at", "_side"], [F.xxhash64("_span")], _far=running_max("_reach"))
    return marked.filter("_side = 1").select(
        "_span.*", F.coalesce(F.col("_far") >= F.col(f"_span.{first}"), F.lit(False)).alias(name)
    )


def overlap_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str]
) -> DataFrame:
    """All pairs of overlapping closed intervals with equal keys.

    An interval's level is the power of two above its length, so it touches at most two buckets of that size. Pairs
    meet in the buckets of the longer interval's level: each interval is listed at its own level, and at the greater
    levels that the other side has, of which there are 64 at most. So the lists don't depend on how long intervals
    are or how far they reach. A pair is kept only in the later of its two first buckets, which needs no duplicate
    removal. A crowded bucket is left to the skew join.
    """
    sides = []
    for frame, (begin, end) in ((left, left_span), (right, right_span)):
        length = F.greatest(F.col(end) - F.col(begin), F.lit(0))
        sides.append(frame.withColumn("_own", F.length(F.bin(length))))
    found = [side.select(F.lit(n).alias("side"), "_own").filter("_own is not null").distinct() for n, side in enumerate(sides)]
    levels: list[list[int]] = [[], []]
    for n, own in sorted(found[0].unionByName(found[1]).collect()):
        levels[n].append(own)

    def listed(side: int) -> DataFrame:
        # by turn: the right one's own level meets all levels of the left, then the left one's own the greater of the right
        begin, end = (left_span, right_span)[side]
        own = F.struct(F.col("_own").alias("level"), F.lit(0).alias("turn"))
        greater = F.filter(F.array(*[F.lit(n) for n in levels[1 - side]]).cast("array<int>"), lambda n: n > F.col("_own"))
        also = F.transform(greater, lambda n: F.struct(n.alias("level"), F.lit(side).alias("turn")))
        mine = F.array(own, F.struct(F.col("_own").alias("level"), F.lit(1).alias("turn"))) if side == 0 else F.array(own)
        spread = sides[side].withColumn("_at", F.explode(F.concat(mine, also))).drop("_own").withColumns({"_level": F.col("_at.level"), "_turn": F.col("_at.turn")})
        return spread.drop("_at").withColumn("_bucket", F.explode(F.expr(f"sequence(shiftright({begin}, _level), shiftright({end}, _level))")))

    (lb, le), (rb, re_) = left_span, right_span
    first_common = F.greatest(F.expr(f"shiftright({lb}, _level)"), F.expr(f"shiftright({rb}, _level)"))
    return (
        listed(0)
        .join(listed(1), [*keys, "_level", "_bucket", "_turn"])
        .filter((F.col(lb) <= F.col(re_)) & (F.col(le) >= F.col(rb)) & (F.col("_bucket") == first_common))
        .drop("_level", "_bucket", "_turn")
    )
