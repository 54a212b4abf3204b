"""What the corpus operators share: pinned tables, checked broadcasts and places in a total order."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows up to which a side of one short row per key may be broadcast.
SMALL_ROWS = 50_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a local session may lack that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/corpus-{uuid.uuid4()}"


#: Folders written while :func:`released` holds, innermost last.
_WRITTEN: list[list[str]] = []


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what :func:`pin` writes meanwhile; whatever is kept must have been written elsewhere by then."""
    _WRITTEN.append([])
    try:
        yield
    finally:
        for path in _WRITTEN.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def pin(df: DataFrame) -> DataFrame:
    """Write a result that is read more than once, or whose rows must stay where they are, and read it back."""
    path = shared_folder(df.sparkSession)
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def identified(df: DataFrame, stored: bool) -> DataFrame:
    """Add ``_id``, unique for each row and the same whenever the rows are read.

    Rows ``stored`` in files that are read plainly are known by file and place, so wide ones need not be written again.
    """
    if stored and "_metadata" not in df.columns:
        try:
            place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
            return df.withColumn("_id", place)
        except AnalysisException:
            pass  # no files below
    return pin(df.withColumn("_id", F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row"))))


def checked(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Mark a pinned side for broadcast if it has few rows; Spark chooses the join of a larger one."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def key_of(column: str) -> Column:
    """A key that is never null and tells null from every text."""
    return F.coalesce(F.concat(F.lit("s"), F.col(column).cast("string")), F.lit("n"))


def placed(df: DataFrame, *order: Column) -> DataFrame:
    """Pin ``df`` in the given order, dealt by ranges: ``_chunk`` numbers the ranges, ``_row`` is unique and ascends.

    Equal rows share a range; columns that break ties keep the ranges even.
    """
    dealt = df.repartitionByRange(parts(df.sparkSession), *order).sortWithinPartitions(*order)
    return pin(dealt.withColumn("_row", F.monotonically_increasing_id())).withColumn(
        "_chunk", F.shiftright("_row", 33)
    )


def rank_within(df: DataFrame, by: str) -> DataFrame:
    """Add ``_rank``, the place of each row of a placed table among those of its ``by``, from 0.

    The rows of a ``by`` must lie together in the order. A chunk holds a run of each ``by``, so its first row and the
    rows of the chunks before give the rank; no window sees the rows themselves.
    """
    runs = df.groupBy(by, "_chunk").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    joined = df.join(checked(pin(runs)), [by, "_chunk"])
    return joined.withColumn("_rank", F.col("_row") - F.col("_first") + F.col("_before")).drop("_first", "_before")


def pin_by(df: DataFrame, key: str) -> DataFrame:
    """Write a table bucketed by ``key`` to the warehouse: joins on ``key`` read it where it lies, without a shuffle."""
    name = f"corpus_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(parts(df.sparkSession), key).saveAsTable(name)
    return df.sparkSession.table(name)
