"""One row per camera and per channel with what a status page shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.functions.playout import clip_remaining, tally_effective
from reelgrid.functions.timebase import timecode
from reelgrid.operators.store import protect_mark


def camera_status(frames: DataFrame, ranges: DataFrame, num: int, den: int) -> DataFrame:
    """Bounds, counts and the newest timecode of each camera."""
    marked = protect_mark(frames.select("camera", "tai_ns", "payload_bytes"), ranges)
    return (
        marked.groupBy("camera")
        .agg(
            F.min("tai_ns").alias("oldest_ns"),
            F.max("tai_ns").alias("newest_ns"),
            F.count("*").alias("frames"),
            F.count_if("protected").alias("protected_frames"),
            F.sum("payload_bytes").alias("bytes"),
        )
        .withColumn("timecode", timecode("newest_ns", num, den))
    )


def channel_status(states: DataFrame, tally: DataFrame, order: str, num: int, den: int) -> DataFrame:
    """The last transport state and tally colour of each channel, its timecode, angle, lock and the time left to its OUT mark."""
    last = states.groupBy("channel").agg(
        F.max_by(F.struct("mode", "position_ns", "speed", "out_ns", "angle", "locked"), order).alias("_s")
    )
    colour = tally.groupBy("channel").agg(F.max_by(tally_effective("lh", "rh", "txt"), "tai_ns").alias("tally"))
    return last.join(colour, "channel", "left").select(
        "channel", "_s.mode", "_s.position_ns", timecode("_s.position_ns", num, den).alias("timecode"), "tally",
        "_s.speed", "_s.angle", "_s.locked", clip_remaining("_s.position_ns", "_s.out_ns", "_s.speed").alias("left_ns"),
    )
