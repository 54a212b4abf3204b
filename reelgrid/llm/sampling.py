"""Bounded, repeatable samples of labelled documents for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.shared import pin


def held_out(key: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, by ``folds``."""
    left = F.pmod(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")), F.lit(folds)) == fold
    return F.coalesce(left, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, key: str = "doc_id") -> tuple[DataFrame, dict[int, float]]:
    """Up to ``most`` documents of each class, and how many labelled rows each stands for.

    The sample is chosen from the labels alone, in the order of a hash, so documents are read once and only the chosen
    ids are sent to them. Held-out ids are never chosen; of a repeated id the greater label counts; null labels and
    ids are skipped.
    """
    own = labels.filter(~held_out(key) & F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.max(label).alias("_label"))
    own = pin(own.filter(F.col("_label").isin(0, 1)))
    counts = {int(r["_label"]): r["count"] for r in own.groupBy("_label").count().collect()}
    order = (F.xxhash64(F.lit(101), F.col("_id").cast("string")), F.col("_id"))
    chosen = own.filter("_label = 0").orderBy(*order).limit(most).unionByName(own.filter("_label = 1").orderBy(*order).limit(most))
    rows = docs.join(F.broadcast(chosen), F.col(f"`{key}`") == F.col("_id"))
    return rows, {k: n / max(1, min(n, most)) for k, n in counts.items()}
