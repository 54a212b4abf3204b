"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.shared import checked, pin


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long) that isn't its component's smallest.

    Alternating stars: each node hands its larger neighbours to the smallest it knows, then its smaller ones, until
    every node points at its root. Each round moves at most one row per link and halves the distances, so the number of
    rounds follows the logarithm of the longest chain. Each round is a written table, which ends its lineage.
    """
    ends = F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")
    now = pin(links.filter("a <> b").select(*ends).distinct())
    sign = None
    while True:
        both = now.unionByName(now.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = pin(both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("least")))
        large = now.join(checked(least.withColumnRenamed("node", "root")), "root").select("node", F.col("least").alias("root"))
        # links that go down from a node are handed on by it as well
        down = now.join(checked(least), "node").select(F.col("root").alias("node"), F.col("least").alias("root"))
        step = large.unionByName(down).unionByName(least.select("node", F.col("least").alias("root")))
        now = pin(step.filter("node <> root").distinct())
        row = now.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if (row[0], row[1]) == sign:
            return now.groupBy("node").agg(F.min("root").alias("root"))
        sign = (row[0], row[1])
