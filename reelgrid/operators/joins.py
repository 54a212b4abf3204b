"""Lookups of recorded frames and joins of catalogue rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.functions.timebase import idiv, timecode
from reelgrid.plans.asof import asof, nearest


def nearest_frame(
    probes: DataFrame, frames: DataFrame, at: str = "at_ns", columns: list[str] | None = None, in_order: bool = False
) -> DataFrame:
    """Each probe with the nearest recorded frame of its camera, the earlier one on a tie (null without frames)."""
    return nearest(probes, frames, ["camera"], at, "tai_ns", columns, in_order=in_order)


def shown_frames(probes: DataFrame, frames: DataFrame, num: int, den: int, in_order: bool = False) -> DataFrame:
    """The frame shown at each output position, how far off it is, and its timecode."""
    found = nearest_frame(probes, frames, columns=["event_id"], in_order=in_order)
    at = F.col("frame.tai_ns")
    return found.select(
        "probe", "camera", "at_ns", at.alias("frame_ns"), F.col("frame.event_id").alias("frame_id"),
        (at - F.col("at_ns")).alias("off_ns"), timecode(at, num, den).alias("tc"),
    )


def at_or_before(probes: DataFrame, frames: DataFrame, at: str = "at_ns", columns: list[str] | None = None) -> DataFrame:
    return asof(probes, frames, ["camera"], at, "tai_ns", columns, before="frame", after=None)


def after(
    probes: DataFrame, frames: DataFrame, at: str = "at_ns", columns: list[str] | None = None, in_order: bool = False
) -> DataFrame:
    return asof(probes, frames, ["camera"], at, "tai_ns", columns, before=None, after="frame", in_order=in_order)


def nearest_audio(probes: DataFrame, frames: DataFrame, period_ns: int, audio: list[str], in_order: bool = False) -> DataFrame:
    """The sound a position reads: that of the frame nearest to the rounded house time; pictures are not touched."""
    rounded = idiv(F.col("at_ns") + period_ns // 2, period_ns) * period_ns
    return nearest(probes.withColumn("audio_ns", rounded), frames, ["camera"], "audio_ns", "tai_ns", audio, in_order=in_order)


def snap_to_frame(edits: DataFrame, frames: DataFrame, at: str, tolerance: int | Column, name: str = "snapped_ns") -> DataFrame:
    """Move an instant onto the nearest frame; null when none lies within the tolerance (one source period)."""
    found = nearest_frame(edits, frames, at)
    close = F.abs(F.col("frame.tai_ns") - F.col(at)) <= tolerance
    return found.withColumn(name, F.when(close, F.col("frame.tai_ns"))).drop("frame")


def angle_align(positions: DataFrame, cameras: DataFrame, frames: DataFrame) -> DataFrame:
    """What every camera shows at the same position. The camera list is that of one machine's inputs."""
    listed = cameras.agg(F.sort_array(F.collect_set("camera"))).scalar()
    spread_out = positions.drop("camera").withColumn("camera", F.explode(listed))
    return nearest_frame(spread_out, frames)


def dangling(sources: DataFrame, column: str, targets: DataFrame) -> DataFrame:
    """Flag references whose target is gone; a cleared reference is what a delete leaves behind.

    Rows that refer to nothing, mostly the greater part, are set aside and don't meet in the join.
    """
    named = F.coalesce(F.col(column) != "", F.lit(False))
    known = targets.select(F.col("id").alias(column), F.lit(True).alias("_known"))
    joined = sources.filter(named).join(known, column, "left")
    gone = F.col("_known").isNull()
    flagged = joined.withColumn("dangling", gone).withColumn("cleared", F.when(gone, "").otherwise(F.col(column)))
    free = sources.filter(~named)
    none = F.when(F.col(column).isNull(), F.lit(None)).otherwise(F.lit(False))
    return flagged.drop("_known").unionByName(free.withColumn("dangling", none).withColumn("cleared", F.col(column)))


def display_channel(tally: DataFrame, mapping: str, screen: int | None = None) -> DataFrame:
    """Channel each display drives: ``display:channel`` pairs, or display + 1 without a map; unmapped rows drop out."""
    kept = tally if screen is None else tally.filter(F.col("screen") == screen)
    if not mapping:
        return kept.withColumn("channel", F.col("display") + 1)
    pairs = F.str_to_map(F.lit(mapping), F.lit(","), F.lit(":"))
    channel = F.try_element_at(pairs, F.col("display").cast("string")).cast("int")
    return kept.withColumn("channel", channel).filter(F.col("channel") > 0)


def locked_positions(positions: DataFrame, locked: Column) -> DataFrame:
    """A locked channel takes the first channel's position of the same grain; a grain has one row per channel."""
    first = F.max(F.when(F.col("channel") == 1, F.col("position"))).over(Window.partitionBy("grain"))
    follows = locked & (F.col("channel") > 1)
    return positions.withColumn("position", F.when(follows, F.coalesce(first, "position")).otherwise(F.col("position")))
