"""The recorded timeline of each camera: ordered append, segments, retention and protection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.functions.timebase import bytes_per_hour, idiv
from reelgrid.plans.greedy import greedy_groups
from reelgrid.plans.intervals import touched
from reelgrid.plans.ordered import (
    CHUNK,
    next_value,
    over_timeline,
    previous_row,
    running,
    running_count,
    running_max,
    running_sum,
    spread,
)

# Bytes a segment and a stored frame take beside their contents; an upload's growth and its reserve.
SEGMENT_HEADER_BYTES = 8
RECORD_HEADER_BYTES = 16
UPLOAD_EXPANSION = 8
UPLOAD_RESERVE_BYTES = 1 << 30
PCM_BYTES_PER_HOUR = 48000 * 2 * 4 * 3600


def ordered_append(arrivals: DataFrame, ranges: DataFrame, order: list[str]) -> DataFrame:
    """Each arriving frame with its ``verdict``: stored, replaced (by a later one of the same instant) or dropped.

    A frame is taken when it is newer than every earlier arrival of its camera; one of the same instant as the newest
    takes its place unless that instant is protected. The newest accepted instant is the newest arrival so far,
    because each new maximum is accepted, so a running maximum decides.
    """
    marked = touched(arrivals, ranges, ["camera"], "tai_ns", "tai_ns", name="_kept")
    cut = spread(marked, ["camera"], order)
    seen = running(cut, ["camera"], order, _newest=running_max("tai_ns", before=True))
    newer = F.col("_newest").isNull() | (F.col("tai_ns") > F.col("_newest"))
    taken = newer | ((F.col("tai_ns") == F.col("_newest")) & ~F.col("_kept"))
    # Frames taken never go back in time, so the next taken one tells whether this one is replaced.
    judged = seen.withColumn("_taken", taken).withColumn("_instant", F.when(F.col("_taken"), F.col("tai_ns")))
    after = running(judged, ["camera"], order, again=True, _next=next_value("_instant"))
    verdict = (
        F.when(~F.col("_taken"), "dropped")
        .when(F.col("_next") == F.col("tai_ns"), "replaced")
        .otherwise("stored")
    )
    return after.withColumn("verdict", verdict).drop("_kept", "_newest", "_taken", "_instant", "_next", CHUNK)


def segment_assign(frames: DataFrame, length_ns: int, carry: list[str] | None = None) -> DataFrame:
    """(camera, tai_ns, carry, segment, first_ns): a segment starts beyond ``length_ns`` after the last one's first."""
    return greedy_groups(frames, ["camera"], "tai_ns", length_ns, carry=carry).select(
        "camera", "tai_ns", *(carry or []), F.col("group_no").alias("segment"), F.col("group_first").alias("first_ns")
    )


def segment_stats(frames: DataFrame) -> DataFrame:
    """First, last, frames and bytes of each segment of frames with ``segment``; a camera's newest segment is open."""
    stats = (
        frames.groupBy("camera", "segment")
        .agg(
            F.min("tai_ns").alias("first_ns"),
            F.max("tai_ns").alias("last_ns"),
            F.count("*").alias("frames"),
            (F.sum(F.col("payload_bytes") + RECORD_HEADER_BYTES) + SEGMENT_HEADER_BYTES).alias("bytes"),
        )
    )
    newest = stats.groupBy("camera").agg(F.max("segment").alias("_newest"))
    return stats.join(newest, "camera").withColumn("is_open", F.col("segment") == F.col("_newest")).drop("_newest")


def retention(segments: DataFrame, ranges: DataFrame, retention_ns: int) -> DataFrame:
    """Segments with ``expired``: closed, wholly older than the retention, and not touched by a protected range."""
    newest = segments.groupBy("camera").agg(F.max("last_ns").alias("_newest"))
    flagged = touched(segments, ranges, ["camera"], "first_ns", "last_ns", name="protected").join(newest, "camera")
    old = (F.col("_newest") > retention_ns) & (F.col("last_ns") < F.col("_newest") - retention_ns)
    return flagged.withColumn("expired", old & ~F.col("is_open") & ~F.col("protected")).drop("_newest")


def protect_mark(frames: DataFrame, ranges: DataFrame) -> DataFrame:
    """Frames with ``protected``: covered by any closed range, whichever way round its ends are given."""
    return touched(frames, ranges, ["camera"], "tai_ns", "tai_ns", name="protected")


def range_release(ranges: DataFrame, released: DataFrame) -> DataFrame:
    """Remove exactly one matching range per release; an equal range of another clip stays.

    Both bags are counted per distinct range before they meet, so many equal ranges cost one row.
    """
    key = ["camera", "begin_ns", "end_ns"]
    normal = lambda df: df.select(
        "camera", F.least("begin_ns", "end_ns").alias("begin_ns"), F.greatest("begin_ns", "end_ns").alias("end_ns")
    )
    held = normal(ranges).groupBy(*key).agg(F.count("*").alias("_held"))
    gone = normal(released).groupBy(*key).agg(F.count("*").alias("_gone"))
    left = F.col("_held") - F.coalesce("_gone", F.lit(0))
    return held.join(gone, key, "left").select(*key, left.alias("holders")).filter("holders > 0")


def range_holders(clips: DataFrame) -> DataFrame:
    """Clips that hold their range: all but those consolidated out of a camera's buffer (camera 0 is the library)."""
    return clips.filter((F.col("camera") == 0) | ~F.col("library"))


def discard_from(segments: DataFrame, ranges: DataFrame, from_ns: Column) -> DataFrame:
    """Segments removed after a failed upload: starting at or after an instant, touched by no range."""
    return (
        touched(segments, ranges, ["camera"], "first_ns", "last_ns")
        .filter((F.col("first_ns") >= from_ns) & ~F.col("touched"))
        .drop("touched")
    )


def protected_bytes(segments: DataFrame, ranges: DataFrame) -> DataFrame:
    """Bytes of whole segments any range touches, and their share of the disk, per camera."""
    held = F.sum(F.when(F.col("touched"), F.col("bytes")).otherwise(0))
    total = F.sum("bytes")
    return (
        touched(segments, ranges, ["camera"], "first_ns", "last_ns")
        .groupBy("camera")
        .agg(
            held.alias("protected_bytes"),
            total.alias("disk_bytes"),
            F.when(total == 0, 0.0).otherwise(held * 100.0 / total).alias("percent"),
        )
    )


def protection_cap(protected: DataFrame, cameras: DataFrame, width: int, height: int, quality: int, max_pct: float) -> DataFrame:
    """One row: protected bytes, the budget of all configured buffers, and whether the cap is reached."""
    per_hour = bytes_per_hour(F.lit(width), F.lit(height), F.lit(quality), F.col("fps"))
    budget = cameras.select("camera", F.floor(per_hour * F.col("hours")).cast("long").alias("_budget"))
    joined = budget.join(protected.select("camera", "protected_bytes"), "camera", "left")
    total = joined.agg(
        F.sum(F.coalesce("protected_bytes", F.lit(0))).alias("protected_bytes"), F.sum("_budget").alias("budget_bytes")
    )
    reached = F.col("protected_bytes") * 100.0 / F.col("budget_bytes") >= max_pct
    return total.withColumn("over_cap", (F.col("budget_bytes") > 0) & reached)


def camera_budget(cameras: DataFrame, width: int, height: int, quality: int) -> DataFrame:
    """Bytes each camera's buffer needs: its pictures (estimated) and its sound."""
    video = bytes_per_hour(F.lit(width), F.lit(height), F.lit(quality), F.col("fps")) * F.col("hours")
    return cameras.select("camera", F.floor(video + F.col("hours") * PCM_BYTES_PER_HOUR).cast("long").alias("need_bytes"))


def capacity_plan(cameras: DataFrame, disk: DataFrame, free_bytes: int, width: int, height: int, quality: int) -> DataFrame:
    """One row: bytes needed, used and still to grow into, and whether the buffers fit."""
    need = camera_budget(cameras, width, height, quality)
    both = need.join(disk.select("camera", "disk_bytes"), "camera", "left").agg(
        F.sum("need_bytes").alias("need_bytes"), F.sum(F.coalesce("disk_bytes", F.lit(0))).alias("used_bytes")
    )
    growth = F.greatest(F.col("need_bytes") - F.col("used_bytes"), F.lit(0).cast("long"))
    return both.withColumn("growth_bytes", growth).withColumn(
        "fits", F.col("used_bytes") + free_bytes >= F.col("need_bytes")
    )


def admit_uploads(requests: DataFrame, growth: Column, free_bytes: Column, cap_mb: int) -> DataFrame:
    """Upload requests with a status: 413 over the size cap, 507 when it would not leave room, else 0."""
    cap = cap_mb * 1024 * 1024
    need = F.col("bytes") * (1 + UPLOAD_EXPANSION) + growth + UPLOAD_RESERVE_BYTES
    status = F.when((F.lit(cap) > 0) & (F.col("bytes") > cap), 413).when(free_bytes < need, 507).otherwise(0)
    return requests.withColumn("status", status)


def stale_cameras(stored: DataFrame, configured: DataFrame, clips: DataFrame) -> DataFrame:
    """Stored cameras that are no longer configured and that no clip uses."""
    return stored.join(configured.select("camera"), "camera", "left_anti").join(
        clips.select("camera").distinct(), "camera", "left_anti"
    )


def upload_place(uploads: DataFrame, newest_ns: int | Column, period_ns: int, order: str = "upload") -> DataFrame:
    """IN and OUT of uploads put one after the other on the library's grid, after its newest frame."""
    origin = (idiv(newest_ns if isinstance(newest_ns, Column) else F.lit(newest_ns).cast("long"), period_ns) + 1) * period_ns
    placed = over_timeline(
        uploads.withColumn("_all", F.lit(0)), ["_all"], [order], _before=running_sum("frames", before=True)
    )
    start = origin + F.col("_before") * period_ns
    return placed.select(
        *uploads.columns, start.alias("in_ns"), (start + (F.col("frames") - 1) * period_ns).alias("out_ns")
    )


def repeated_pictures(frames: DataFrame, fingerprint: str) -> DataFrame:
    """Frames with ``repeated`` (the picture of the frame before) and ``picture_run``, the number of their run.

    ``fingerprint`` stands for the payload (its SHA-256, say), so payloads stay out of the shuffle.
    """
    cut = spread(frames, ["camera"], ["tai_ns"])
    seen = running(cut, ["camera"], ["tai_ns"], _was=previous_row(fingerprint))
    flagged = seen.withColumn(
        "repeated", F.coalesce(F.col(f"_was.{fingerprint}").eqNullSafe(F.col(fingerprint)) & F.col("_was").isNotNull(), F.lit(False))
    )
    return running(flagged, ["camera"], ["tai_ns"], again=True, picture_run=running_count(~F.col("repeated"))).drop("_was", CHUNK)
