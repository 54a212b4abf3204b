"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelgrid.llm.shared import SMALL_ROWS, checked, identified, key_of, pin, placed

#: Fixed point of the rounding: sums of these are exact in any order.
UNIT = 1 << 24
STEPS_PER_JOB, JOBS = 4, 8


def words_in(text: str = "text") -> Column:
    """The number of words of a text; none for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """Add ``target`` to a table of (source, _source, source_size), one row per source.

    Sources in code-point order, null last, take the weights in turn and share the sum of all sizes by them. A target
    stops at ``most`` times its source's size; the rest is shared anew among the others. In the order of size per
    weight the stopped sources come first, so one pass of running sums finds the level at which no other stops.
    """
    in_turn = Window.orderBy(F.col("source").asc_nulls_last())
    given = F.array(*[F.lit(float(w)) for w in weights])
    ranked = totals.withColumn(
        "_weight", F.get(given, ((F.row_number().over(in_turn) - 1) % F.lit(len(weights))).cast("int"))
    ).withColumn("_limit", F.col("source_size") * F.lit(float(most)))
    rising = Window.orderBy(F.col("_limit") / F.col("_weight"), "_source")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    none = F.lit(0.0)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("_limit").over(before), none)) / (
        F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(before), none)
    )
    ranked = ranked.withColumn("_level", level)
    free = F.when(F.col("_limit") >= F.col("_level") * F.col("_weight"), F.col("_level"))
    ranked = ranked.withColumn("_final", F.first(free, ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return ranked.withColumn(
        "target", F.least("_limit", F.coalesce(F.col("_final") * F.col("_weight"), F.col("_limit")))
    ).drop("_weight", "_limit", "_level", "_final")


def _exact(term: Column) -> Column:
    return F.sum(term.cast("decimal(28,6)")).cast("double")


def tilts(histogram: DataFrame, goals: DataFrame, most: float) -> DataFrame:
    """Solve the dual for each source: ``tilt`` with sum of size * min(most, exp(tilt * size / mean)) = target.

    The sum is over the documents of a source, read from its (size, documents) histogram. Each step is one distributed
    sum and one Newton step on the logarithm of the sum, which is close to linear; a step that leaves the bracket is
    replaced by its middle. Sums are decimal, so their order doesn't matter and reruns agree.
    """
    mean = F.col("source_size") / F.col("_documents")
    top = F.lit(math.log(most)) * F.col("_mean") / F.col("_least")
    state = goals.withColumn("_mean", mean).withColumn("_high", top).withColumn("_low", -40 * F.col("_mean") / F.col("_least"))
    state = state.select("_source", "target", "_mean", "_low", "_high", F.lit(0.0).alias("tilt"), F.lit(1.0).alias("_off"))
    state = pin(state)
    histogram = histogram.select("_source", "_size", "_n")
    few = state.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    for _ in range(JOBS):
        for _ in range(STEPS_PER_JOB):
            bulk = histogram.join(F.broadcast(state) if few else state, "_source")
            size, n = F.col("_size").cast("double"), F.col("_n")
            raw = F.exp(F.least(F.col("tilt") * size / F.col("_mean"), F.lit(math.log(most))))
            bound = F.col("tilt") * size / F.col("_mean") >= F.lit(math.log(most))
            slope = F.when(bound, F.lit(0.0)).otherwise(n * size * raw * size / F.col("_mean"))
            kept = [F.first(c).alias(c) for c in ("target", "_mean", "_low", "_high", "tilt")]
            state = bulk.groupBy("_source").agg(_exact(n * size * raw).alias("_got"), _exact(slope).alias("_slope"), *kept)
            over = F.col("_got") > F.col("target")
            state = state.withColumn("_high", F.when(over, F.col("tilt")).otherwise(F.col("_high"))).withColumn(
                "_low", F.when(over, F.col("_low")).otherwise(F.col("tilt"))
            )
            step = F.col("tilt") + F.log(F.col("target") / F.col("_got")) * F.col("_got") / F.col("_slope")
            inside = (step > F.col("_low")) & (step < F.col("_high"))
            state = state.withColumn("_off", F.abs(F.col("_got") / F.col("target") - 1)).withColumn(
                "tilt",
                F.when(F.col("_off") < 1e-7, F.col("tilt"))
                .when(inside, step)
                .otherwise((F.col("_low") + F.col("_high")) / 2),
            ).drop("_got", "_slope")
        state = pin(state)
        if not state.filter(F.col("_off") >= 1e-6).limit(1).count():
            break
    return state


def mix(
    rows: DataFrame,
    size: str = "size",
    source: str = "source",
    key: str = "doc_id",
    weights: tuple[float, ...] = (1, 2, 3),
    most: float = 3.0,
    seed: int = 29,
    stored: bool = False,
) -> DataFrame:
    """Say how often to take each document so that sources reach their targets in words.

    Entropy balancing: among all document rates that meet each source's target, the ones closest to 1 are
    exp(tilt * size), at most ``most``. Rates become copies by systematic rounding along each source's documents,
    ordered by size: documents of like size stand together, so a source's error stays near one document. Two last
    steps move one copy of the document whose size is nearest to what is left.

    Returns the columns given, ``source_size``, ``target`` and ``copies`` (0 to ``most``). Null or non-positive sizes
    count as 0 and are taken once, as they weigh nothing; a null source is a source of its own; equal rows are told
    apart by their place; an empty table stays empty. Columns named like the results are replaced.
    """
    rows = rows.drop("source_size", "target", "copies")
    packed = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_kept"),
        key_of(source).alias("_source"),
        F.col(f"`{source}`").cast("string").alias("source"),
        F.greatest(F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)), F.lit(0)).alias("_size"),
        F.xxhash64(F.lit(seed), F.col(f"`{key}`").cast("string")).alias("_shuffled"),
        F.col(f"`{key}`").cast("string").alias("_key"),
    )
    rows = identified(packed, stored)
    narrow = pin(rows.drop("_kept"))
    wide = placed(narrow, *[F.col(c) for c in ("_source", "_size", "_shuffled", "_key", "_id")])
    histogram = pin(wide.groupBy("_source", "source", "_size").agg(F.count("*").alias("_n")))
    totals = histogram.groupBy("_source", "source").agg(
        F.sum(F.col("_size") * F.col("_n")).alias("source_size"),
        F.sum(F.when(F.col("_size") > 0, F.col("_n"))).alias("_documents"),
        F.min(F.when(F.col("_size") > 0, F.col("_size"))).alias("_least"),
    )
    goals = pin(targets(totals, weights, most))
    # a source without words, or held at its limit, needs no tilt
    full = F.col("target") >= F.col("source_size") * F.lit(most * (1 - 1e-12))
    open_goals = goals.filter((F.col("target") > 0) & ~full)
    solved = tilts(histogram, open_goals, most).select("_source", "tilt", "_mean")
    plan = pin(goals.join(solved, "_source", "left"))
    rate = F.when(F.col("_size") == 0, F.lit(1.0)).when(F.col("tilt").isNull(), F.lit(float(most))).otherwise(
        F.exp(F.least(F.col("tilt") * F.col("_size") / F.col("_mean"), F.lit(math.log(most))))
    )
    chosen = _rounded(wide, checked(plan.select("_source", "target", "tilt", "_mean")), rate, most)
    ends = checked(plan.select("_source", "source_size", "target"))
    counts = wide.select("_row", "_id", "_source").join(chosen.select("_row", "copies"), "_row").join(ends, "_source")
    found = rows.select("_id", "_kept").join(counts.drop("_row", "_source"), "_id")
    return found.select("_kept.*", "source_size", "target", "copies")


def _rounded(wide: DataFrame, plan: DataFrame, rate: Column, most: float) -> DataFrame:
    """Copies for each row of the placed table: rates rounded along the order, then moved towards the targets."""
    rows = wide.select("_row", "_chunk", "_source", "_size").join(plan, "_source").withColumn("_rate", rate)
    rows = rows.withColumn("_part", F.round((F.col("_rate") - F.floor("_rate")) * UNIT).cast("long"))
    rows = rows.select("_row", "_chunk", "_source", "_size", "target", F.floor("_rate").cast("int").alias("_whole"), "_part")
    sums = rows.groupBy("_source", "_chunk").agg(F.sum("_part").alias("_sum"))
    before = Window.partitionBy("_source").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = pin(sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum"))
    inside = Window.partitionBy("_chunk", "_source").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_upto", F.sum("_part").over(inside)).join(checked(sums), ["_source", "_chunk"])
    after = F.col("_before") + F.col("_upto") + UNIT // 2
    step = F.shiftright(after, 24) - F.shiftright(after - F.col("_part"), 24)
    rows = rows.withColumn("copies", (F.col("_whole") + step).cast("int"))
    rows = pin(rows.select("_row", "_source", "_size", "target", "copies"))
    for _ in range(2):
        taken = rows.groupBy("_source").agg(
            F.sum(F.col("copies") * F.col("_size")).alias("_taken"), F.first("target").alias("_goal")
        )
        left = pin(taken.select("_source", (F.col("_goal") - F.col("_taken")).alias("_left")))
        able = F.when(F.col("_left") > 0, F.col("copies") < int(most)).otherwise(F.col("copies") > 0)
        miss = F.abs(F.abs("_left") - F.col("_size"))
        better = rows.join(checked(left), "_source").filter(able & (F.col("_size") > 0) & (miss < F.abs("_left")))
        moved = better.groupBy("_source").agg(F.min_by(F.struct("_row", F.signum("_left").alias("by")), F.struct(miss, "_row")).alias("_move"))
        moved = pin(moved.select("_source", F.col("_move._row").alias("_moved"), F.col("_move.by").cast("int").alias("_by")))
        rows = rows.join(checked(moved), "_source", "left").withColumn(
            "copies", F.col("copies") + F.when(F.col("_row") == F.col("_moved"), F.col("_by")).otherwise(F.lit(0))
        ).drop("_moved", "_by")
    return rows


def mixed(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", stored: bool = False) -> DataFrame:
    """The mix itself: each document as often as :func:`mix` takes it, with the columns it has."""
    sized = docs.withColumn("_words_in_it", words_in(text))
    taken = mix(sized, size="_words_in_it", source=source, key=key, stored=stored)
    repeated = taken.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])
