"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.shared import checked, identified, key_of, pin, placed, rank_within


def interleave(rows: DataFrame, shards: int = 16, source: str = "source", key: str = "doc_id", seed: int = 17, stored: bool = False) -> DataFrame:
    """Deal rows into ``shards`` so that each shard has the mixture of sources and counts differ by one at most.

    Rows are shuffled by a seeded hash of ``key`` within their source; row r of n has the fractional rank
    (r + 0.5) / n. All rows are sorted by that rank and the sequence is cut into equal stretches. Both ranks come from
    range-dealt chunks and one total per chunk, so a source with most of the rows is split like any other. Only keys
    are ranked; the rows themselves move once, to meet their place. ``stored`` says that the rows are a plain read of
    files; others are written first, so that they stay the same.

    Returns the columns given, ``shard`` (0 to shards - 1) and ``slot`` (from 0 without gaps in each shard). A null
    source is a source of its own; null keys and repeated rows each get a place; an empty table stays empty. Columns
    named like the results are replaced.
    """
    rows = rows.drop("shard", "slot")
    packed = rows.select(  # the caller's columns in one, so that their names can't clash with the plan's
        F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_kept"),
        key_of(source).alias("_source"),
        F.xxhash64(F.lit(seed), F.col(f"`{key}`").cast("string")).alias("_shuffled"),
        F.col(f"`{key}`").cast("string").alias("_key"),
    )
    wide = identified(packed, stored)
    narrow = pin(wide.select("_id", "_source", "_shuffled", "_key"))
    order = placed(narrow, *[F.col(c) for c in ("_source", "_shuffled", "_key", "_id")])
    ranked = pin(rank_within(order.select("_row", "_chunk", "_id", "_source", "_shuffled"), "_source"))
    sizes = pin(ranked.groupBy("_source").agg(F.count("*").alias("_n")))
    total = sizes.agg(F.sum("_n")).first()[0]
    ranked = ranked.join(checked(sizes), "_source").select(
        "_id", "_source", "_shuffled", ((F.col("_rank") + 0.5) / F.col("_n")).alias("_fraction")
    )
    line = placed(pin(ranked), *[F.col(c) for c in ("_fraction", "_source", "_shuffled", "_id")])
    line = rank_within(line.select("_row", "_chunk", "_id", F.lit(0).alias("_all")), "_all")
    shard = F.floor(F.col("_rank") * F.lit(shards) / F.lit(total)).cast("int")
    cut = line.select("_id", shard.alias("shard"), F.col("_rank").alias("_place"))
    start = F.ceil(F.col("shard") * F.lit(total) / F.lit(shards)).cast("long")
    cut = cut.withColumn("slot", F.col("_place") - start).drop("_place")
    return wide.select("_id", "_kept").join(cut, "_id").select("_kept.*", "shard", "slot")
