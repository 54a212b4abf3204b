"""The stored frames of all cameras: a Parquet table partitioned by camera and day, sorted by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.functions.timebase import idiv
from reelgrid.operators.store import RECORD_HEADER_BYTES, SEGMENT_HEADER_BYTES
from reelgrid.plans.asof import nearest
from reelgrid.plans.ordered import over_timeline, running_sum

DAY_NS = 86_400_000_000_000


def write_frames(frames: DataFrame, path: str) -> None:
    """Append frames. A range partitioning keeps files sorted and even, also for a camera with most of the rows."""
    parts = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dated = frames.withColumn("day", idiv("tai_ns", DAY_NS))
    (
        dated.repartitionByRange(parts, "camera", "day", "tai_ns")
        .sortWithinPartitions("camera", "day", "tai_ns")
        .write.mode("append")
        .partitionBy("camera", "day")
        .parquet(path)
    )


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_frames(frames: DataFrame, cameras: list[int], from_ns: int | Column, to_ns: int | Column) -> DataFrame:
    """Frames of some cameras in a closed time range; on the stored table whole days are skipped."""
    kept = frames.filter(F.col("camera").isin(cameras) & F.col("tai_ns").between(from_ns, to_ns))
    if "day" in frames.columns and isinstance(from_ns, int) and isinstance(to_ns, int):
        kept = kept.filter(F.col("day").between(from_ns // DAY_NS, to_ns // DAY_NS))
    return kept


def frame_bounds(frames: DataFrame) -> DataFrame:
    """Oldest, newest and number of frames per camera; payload columns are never read."""
    return frames.groupBy("camera").agg(
        F.min("tai_ns").alias("oldest_ns"), F.max("tai_ns").alias("newest_ns"), F.count("*").alias("frames")
    )


def segment_spans(frames: DataFrame, from_ns: Column | int, to_ns: Column | int) -> DataFrame:
    """The byte range of each segment that holds a time range.

    ``frames``: camera, segment, tai_ns, payload_bytes. Records lie one after the other behind the segment's header.
    """
    size = F.col("payload_bytes") + RECORD_HEADER_BYTES
    placed = over_timeline(frames, ["camera", "segment"], ["tai_ns"], _end=running_sum(size))
    end = F.col("_end") + SEGMENT_HEADER_BYTES
    return (
        placed.filter(F.col("tai_ns").between(from_ns, to_ns))
        .groupBy("camera", "segment")
        .agg(F.min(end - size).alias("begin_byte"), F.max(end).alias("end_byte"))
    )


def clip_extract(clips: DataFrame, frames: DataFrame, period_ns: int, columns: list[str]) -> DataFrame:
    """Every grid position of each clip with its nearest frame, numbered from 0.

    Sound stays in the rows: written in (clip, n) order the blocks follow one another.
    """
    grid = F.posexplode(F.sequence("in_ns", "out_ns", F.lit(period_ns).cast("long")))
    positions = clips.select("id", "camera", grid.alias("n", "at_ns"))
    found = nearest(positions, frames, ["camera"], "at_ns", "tai_ns", columns)
    return found.select("id", "camera", "n", "at_ns", "frame.*")
