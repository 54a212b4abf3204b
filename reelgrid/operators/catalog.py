"""Catalogue tables: scans, edits, searches and rules over clips, playlists and their entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reelgrid.functions.identity import normalise, serial
from reelgrid.functions.playout import play_time

# The accepted ranges of catalogue fields, as (field, low, high, whole numbers only).
CLIP_SPEED = (0.01, 2.0)
LIMITS = [
    ("transition_frames", 0, 250, True),
    ("audio_frames", -1, 250, True),
    ("level_db", -60, 12, False),
    ("fade_out_frames", 0, 1000, True),
    ("duck_db", -60, 0, False),
    ("attack_ms", 0, 5000, True),
    ("release_ms", 0, 10000, True),
]


def camera_factor(rows: DataFrame, cameras: DataFrame, house_num: int, house_den: int) -> DataFrame:
    """Add ``factor``: source frames per house frame of the row's camera (1 for an unknown camera).

    ``cameras`` is the configured camera list (one row per input of one machine).
    """
    factor = F.when(
        F.col("native_fps") > 0, F.col("native_fps").cast("double") * house_den / house_num
    ).otherwise(F.greatest(F.lit(1), F.col("phases")).cast("double"))
    known = cameras.select("camera", factor.alias("factor"))
    return rows.join(known, "camera", "left").fillna({"factor": 1.0})


def next_serial(ids: DataFrame) -> DataFrame:
    """Next free serial of each id kind and over all of them."""
    per_kind = ids.groupBy(F.substring_index("id", "-", 1).alias("kind")).agg(
        (F.max(serial("id")) + 1).alias("next_serial")
    )
    return per_kind.unionByName(
        per_kind.agg(F.lit("all").alias("kind"), F.max("next_serial").alias("next_serial"))
    )


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Insert-or-replace: the row with the greatest version of each key, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.{c}") for c in rest])


def upsert(stored: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Stored rows with the changes applied; of several changes to one id the last one stays."""
    wanted = latest(changes, [key], order).drop(order)
    return stored.join(wanted.select(key), key, "left_anti").unionByName(wanted)


def replace_entries(stored: DataFrame, replacement: DataFrame) -> DataFrame:
    """Replace the entry lists of the playlists named in ``replacement`` as whole sets."""
    return stored.join(replacement.select("playlist").distinct(), "playlist", "left_anti").unionByName(replacement)


def delete(rows: DataFrame, doomed: DataFrame, key: str) -> DataFrame:
    return rows.join(doomed, key, "left_anti")


def evolve(rows: DataFrame, target: StructType, defaults: dict[str, object]) -> DataFrame:
    """Bring a table to the target schema: missing columns get their declared defaults; others stay."""
    have = set(rows.columns)
    columns = [
        (F.col(f.name) if f.name in have else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name)
        for f in target.fields
    ]
    extra = [F.col(c) for c in rows.columns if c not in set(target.fieldNames())]
    return rows.select(*columns, *extra)


def playlist_documents(entries: DataFrame, fields: list[str]) -> DataFrame:
    """One row per playlist with its entries as an array in position order."""
    items = F.sort_array(F.collect_list(F.struct("position", *fields)))
    return entries.groupBy("playlist").agg(items.alias("entries"))


def with_clips(entries: DataFrame, clips: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Entries with the clip they name; ``present`` is false for a deleted clip, whose entry stays."""
    picked = clips.select(
        F.col("id").alias("clip_id"), *[F.col(c).alias(f"clip_{c}") for c in (columns or [])], F.lit(True).alias("present")
    )
    return entries.join(picked, "clip_id", "left").fillna({"present": False})


def unknown_clips(edits: DataFrame, clips: DataFrame, stored: DataFrame) -> DataFrame:
    """Per edited playlist: the first entry naming a clip that neither exists nor was already in the playlist."""
    missing = edits.join(clips.select(F.col("id").alias("clip_id")), "clip_id", "left_anti").join(
        stored.select("playlist", "clip_id"), ["playlist", "clip_id"], "left_anti"
    )
    return missing.groupBy("playlist").agg(
        F.min("position").alias("position"), F.min_by("clip_id", "position").alias("clip_id")
    )


def search(clips: DataFrame, words: Column, cameras: DataFrame, kind: str = "all") -> DataFrame:
    """Clips whose name, id, tags, camera label and IN timecode together contain every word of the query.

    ``words`` is the text typed; ``cameras`` has (camera, label) of the configured inputs.
    """
    kept = {"all": F.lit(True), "buffer": ~F.col("library"), "library": F.col("library")}[kind]
    labelled = clips.filter(kept).join(cameras, "camera", "left")
    haystack = F.lower(F.concat_ws(" ", "name", "id", "tags", "label", "timecode"))
    typed = F.filter(F.split(F.lower(F.trim(words)), r"\s+"), lambda w: w != "")
    return labelled.withColumn("_text", haystack).filter(
        F.forall(typed, lambda w: F.contains(F.col("_text"), w))
    ).drop("_text")


def tags_of(column) -> Column:
    """Trimmed, non-empty tags of a comma list."""
    return F.filter(F.transform(F.split(column, ","), lambda x: F.trim(x)), lambda x: x != "")


def shots(clips: DataFrame, playlists: DataFrame) -> DataFrame:
    """Clips and playlists as one list of playable things with their play time and creation serial."""
    one = clips.select(
        "id", F.lit("clip").alias("kind"), "name", play_time("in_ns", "out_ns", "speed").alias("play_ns")
    )
    many = playlists.select(
        F.col("playlist").alias("id"), F.lit("playlist").alias("kind"), "name", F.col("duration_ns").alias("play_ns")
    )
    return one.unionByName(many).withColumn("serial", serial("id"))


def first_clips(entries: DataFrame, clips: DataFrame, top: int | None = None) -> DataFrame:
    """The distinct existing clips of each playlist in order, the first ``top`` if given."""
    first = (
        entries.join(clips.select(F.col("id").alias("clip_id")), "clip_id", "left_semi")
        .groupBy("playlist", "clip_id")
        .agg(F.min("position").alias("position"))
    )
    rank = F.row_number().over(Window.partitionBy("playlist").orderBy("position"))
    placed = first.withColumn("place", rank)
    return placed if top is None else placed.filter(F.col("place") <= top)


def clip_rule(prefix: str = "") -> Column:
    """The field and kind of the first broken rule of a clip edit, null when it is fine."""
    col = lambda n: F.col(prefix + n)
    low, high = CLIP_SPEED
    return (
        F.when(~normalise("motion", col("motion"))["ok"], "motion:unknown")
        .when(~normalise("audio", col("audio"))["ok"], "audio:unknown")
        .when(~normalise("end_action", col("end_action"))["ok"], "end_action:unknown")
        .when(col("out_ns") < col("in_ns"), "out_ns:order")
        .when((col("speed") < low) | (col("speed") > high), "speed:range")
    )


def limit_rule(fields: list[str]) -> Column:
    """First of the named fields that lies outside its accepted range, null when all are inside (or absent)."""
    rule = F.lit(None).cast("string")
    for name, low, high, whole in reversed([x for x in LIMITS if x[0] in fields]):
        value = F.col(name)
        bad = (value < low) | (value > high)
        if whole:
            bad = bad | (value != F.floor(value))
        rule = F.when(bad, f"{name}:range").otherwise(rule)
    return rule


def entry_rule() -> Column:
    """First broken rule of a playlist entry, in the order the fields are read."""
    low, high = CLIP_SPEED
    return (
        F.when(F.col("clip_id").isNull() | (F.col("clip_id") == ""), "clip_id:missing")
        .when(~normalise("end_action", "end_action")["ok"], "end_action:unknown")
        .when(~normalise("transition", "transition")["ok"], "transition:unknown")
        .when(limit_rule(["transition_frames", "audio_frames"]).isNotNull(), limit_rule(["transition_frames", "audio_frames"]))
        .when((F.col("speed") < low) | (F.col("speed") > high), "speed:range")
    )


def patch(stored: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Partial objects change only the fields they carry."""
    given = changes.select(key, *[F.col(f).alias(f"_new_{f}") for f in fields])
    joined = stored.join(given, key, "left")
    return joined.withColumns({f: F.coalesce(f"_new_{f}", f) for f in fields}).drop(*[f"_new_{f}" for f in fields])


def create_clips(requests: DataFrame, cameras: DataFrame, first_serial: int | Column) -> DataFrame:
    """One clip per selected camera and request, numbered in request order; refused requests keep an ``error``.

    ``requests``: request, channel camera, in_ns, out_ns, target_speed, all_angles, force, over_cap, name.
    ``cameras``: the configured inputs (camera, label, colour), a list of machine size held as one array.
    """
    listed = cameras.agg(
        F.sort_array(F.collect_list(F.struct("camera", "label", "colour"))).alias("all")
    ).scalar()
    error = (
        F.when(
            F.col("in_ns").isNull() | F.col("out_ns").isNull() | (F.col("out_ns") <= F.col("in_ns")), "marks:order"
        ).when(~F.col("force") & F.col("over_cap"), "cap:exceeded")
    )
    one = F.filter(F.col("_cams"), lambda c: c["camera"] == F.col("camera"))
    alone = F.array(
        F.struct(F.col("camera").alias("camera"), one[0]["label"].alias("label"), one[0]["colour"].alias("colour"))
    )
    low, high = CLIP_SPEED
    chosen = (
        requests.withColumn("error", error)
        .withColumn("_cams", listed)
        .withColumn("_angles", F.when(F.col("error").isNotNull(), F.array().cast("array<struct<camera:int,label:string,colour:string>>"))
                    .when(F.col("all_angles"), F.col("_cams")).otherwise(alone))
        .withColumn("_made", F.size("_angles").cast("long"))
    )
    from reelgrid.plans.ordered import over_timeline, running_sum

    numbered = over_timeline(
        chosen.withColumn("_all", F.lit(0)), ["_all"], ["request"], _before=running_sum("_made", before=True)
    )
    base = F.col("_before") + first_serial
    exploded = numbered.select("*", F.posexplode_outer("_angles").alias("_nth", "_cam"))
    made = F.col("_cam").isNotNull()
    clip_id = F.when(made, F.concat(F.lit("clip-"), base + F.col("_nth")))
    name = F.when(F.coalesce("name", F.lit("")) == "", clip_id).otherwise(F.col("name"))
    speed_ok = (F.col("target_speed") >= low) & (F.col("target_speed") <= high)
    return exploded.select(
        "request",
        "error",
        clip_id.alias("id"),
        F.when(made, F.when(F.col("all_angles"), F.concat_ws(" ", name, F.col("_cam.label"))).otherwise(name)).alias("name"),
        F.col("_cam.camera").alias("camera"),
        F.when(made, F.col("in_ns")).alias("in_ns"),
        F.when(made, F.col("out_ns")).alias("out_ns"),
        F.when(made, F.when(speed_ok, F.col("target_speed")).otherwise(1.0)).alias("speed"),
        F.col("_cam.colour").alias("colour"),
        F.when(made & F.col("all_angles"), F.concat(F.lit("group-"), base)).alias("group_id"),
    )
