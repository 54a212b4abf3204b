"""Edits of clips and what a timeline view shows of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.operators.catalog import delete
from reelgrid.operators.joins import snap_to_frame
from reelgrid.operators.store import range_holders, range_release
from reelgrid.plans.intervals import overlap_join
from reelgrid.plans.ordered import over_timeline, running_count

SECOND = 1_000_000_000


def renumbered(entries: DataFrame) -> DataFrame:
    """Entry positions counted from 0 in their order."""
    counted = over_timeline(entries, ["playlist"], ["position"], _nth=running_count(before=True))
    return counted.withColumn("position", F.col("_nth")).drop("_nth")


def update_clips(edits: DataFrame, clips: DataFrame, frames: DataFrame, tolerance_ns: int, over_cap: Column) -> DataFrame:
    """Result of each clip edit, and the clip as it is then stored.

    An end that moves must find a recorded frame within the tolerance and lands on it; a clip that grows while the
    protection cap is reached is refused unless forced. A clip that holds its range moves it (new first, then old).
    """
    old = clips.select(
        "id", F.col("camera").alias("_camera"), F.col("in_ns").alias("_in"), F.col("out_ns").alias("_out"),
        F.col("name").alias("_name"), ((F.col("camera") == 0) | ~F.col("library")).alias("_holds"),
    )
    joined = edits.join(old, "id", "left").withColumn("_known", F.col("_in").isNotNull())
    # both ends look for their frame in one pass over the frames, which are many more than the edits
    whole = joined.withColumn("_row", F.monotonically_increasing_id())
    ends = F.array(F.struct(F.lit(0).alias("side"), F.col("in_ns").alias("at")), F.struct(F.lit(1).alias("side"), F.col("out_ns").alias("at")))
    apart = whole.select(F.struct(*whole.columns).alias("_edit"), "camera", F.explode(ends).alias("_end")).select("_edit", "camera", "_end.side", "_end.at")
    found = snap_to_frame(apart, frames, "at", tolerance_ns, "_snap")
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("_snap")))
    snapped = found.groupBy("_edit").agg(of(0).alias("_snap_in"), of(1).alias("_snap_out")).select("_edit.*", "_snap_in", "_snap_out")
    new_in = F.when(F.col("in_ns") != F.col("_in"), F.col("_snap_in")).otherwise(F.col("in_ns"))
    new_out = F.when(F.col("out_ns") != F.col("_out"), F.col("_snap_out")).otherwise(F.col("out_ns"))
    other = F.col("camera") != F.col("_camera")
    moved = other | (F.col("in_ns") != F.col("_in")) | (F.col("out_ns") != F.col("_out"))
    ready = snapped.withColumns({"_new_in": new_in, "_new_out": new_out, "_moved": moved})
    grows = other | (F.col("_new_in") < F.col("_in")) | (F.col("_new_out") > F.col("_out"))
    result = (
        F.when(~F.col("_known"), "unknown")
        .when(F.col("_moved") & (F.col("_new_in").isNull() | F.col("_new_out").isNull()), "no_frame")
        .when(F.col("_moved") & (F.col("_new_out") < F.col("_new_in")), "out_before_in")
        .when(F.col("_moved") & grows & F.col("_holds") & ~F.col("force") & over_cap, "over_cap")
        .otherwise("ok")
    )
    fine = F.col("result") == "ok"
    name = F.when(F.col("name") == "", F.col("_name")).otherwise(F.col("name"))
    return ready.withColumn("result", result).select(
        "id", "result", F.when(fine, F.col("_new_in")).alias("in_ns"), F.when(fine, F.col("_new_out")).alias("out_ns"),
        F.when(fine, name).alias("name"), F.coalesce(fine & F.col("_moved") & F.col("_holds"), F.lit(False)).alias("range_moved"),
    )


def delete_clips(clips: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remaining clips, and the ranges still held after each deleted clip released its own once."""
    as_ranges = lambda df: range_holders(df).select("camera", F.col("in_ns").alias("begin_ns"), F.col("out_ns").alias("end_ns"))
    gone = clips.join(doomed.select("id").distinct(), "id", "left_semi")
    return delete(clips, doomed, "id"), range_release(as_ranges(clips), as_ranges(gone))


def consolidate_clips(clips: DataFrame, wanted: DataFrame) -> DataFrame:
    """Flag copied-out clips as library; ``released`` marks those that give up their range, only the first time."""
    chosen = wanted.select("id").distinct().withColumn("_chosen", F.lit(True))
    joined = clips.join(chosen, "id", "left").fillna({"_chosen": False})
    return joined.withColumn("released", F.col("_chosen") & ~F.col("library")).withColumn(
        "library", F.col("library") | F.col("_chosen")
    ).drop("_chosen")


def timeline_view(views: DataFrame, bounds: DataFrame, clips: DataFrame, keys: list[str], hours: int, zoom_s: int) -> DataFrame:
    """Visible range of each view (camera, ``position_ns``) and the clips in it, placed in percent."""
    span = zoom_s * SECOND
    first = F.greatest(F.col("oldest_ns"), F.col("newest_ns") - hours * 3600 * SECOND)
    ranged = views.join(bounds, "camera").withColumn("_first", first)
    start = F.greatest(F.col("_first"), F.col("newest_ns") - span) if span else F.col("_first")
    left_of = (F.col("position_ns") < F.col("_start")) & F.lit(span > 0)
    moved = F.greatest(F.col("_first"), F.col("position_ns") - span // 4)
    shown = (
        ranged.withColumn("_start", start)
        .withColumn("start_ns", F.when(left_of, moved).otherwise(F.col("_start")))
        .withColumn("_end", F.when(left_of, F.col("start_ns") + span).otherwise(F.col("newest_ns")))
        .withColumn("end_ns", F.greatest("_end", F.col("start_ns") + SECOND))
        .select(*keys, "camera", "start_ns", "end_ns")
    )
    marks = clips.select("camera", "id", "in_ns", "out_ns")
    pairs = overlap_join(marks, shown, ["camera"], ("in_ns", "out_ns"), ("start_ns", "end_ns"))

    def place(ns: str) -> Column:
        share = (F.col(ns) - F.col("start_ns")).cast("double") * 100 / (F.col("end_ns") - F.col("start_ns"))
        return F.least(F.lit(100.0), F.greatest(F.lit(0.0), share))

    width = F.greatest(F.lit(0.25), place("out_ns") - place("in_ns"))
    return pairs.select(*keys, "camera", "start_ns", "end_ns", "id", place("in_ns").alias("left_pct"), width.alias("width_pct"))
