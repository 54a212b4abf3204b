"""The catalogue as one document: export to nested rows, import with lenient fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from reelgrid.functions.identity import normalise
from reelgrid.functions.playout import DEFAULT_MIX_FRAMES


def _struct(**fields) -> StructType:
    return StructType([StructField(n, t() if isinstance(t, type) else t) for n, t in fields.items()])


CLIP = _struct(
    id=StringType, name=StringType, camera=IntegerType, in_ns=LongType, out_ns=LongType, speed=DoubleType, motion=StringType,
    audio=StringType, colour=StringType, tags=StringType, end=StringType, library=BooleanType, group=StringType,
)
ENTRY = _struct(
    clip_id=StringType, speed=DoubleType, end=StringType, auto_advance=BooleanType, transition=StringType,
    transition_frames=IntegerType, audio_frames=IntegerType, own_audio=BooleanType,
)
AUX = _struct(
    source=StringType, level_db=DoubleType, loop=BooleanType, fade_out_frames=IntegerType, duck_db=DoubleType,
    attack_ms=IntegerType, release_ms=IntegerType,
)
PLAYLIST = _struct(id=StringType, name=StringType, loop=BooleanType, entries=ArrayType(ENTRY), aux=AUX)
SETTING = _struct(key=StringType, value=StringType)
# The defaults of a bed and the ranges of its numbers.
AUX_DEFAULTS = {"source": "", "level_db": 0.0, "loop": True, "fade_out_frames": 50, "duck_db": -12.0, "attack_ms": 200, "release_ms": 500}
AUX_RANGES = {"level_db": (-60, 12), "fade_out_frames": (0, 1000), "duck_db": (-60, 0), "attack_ms": (0, 5000), "release_ms": (0, 10000)}


def _object(rows: DataFrame, shape: StructType, **renamed: str) -> Column:
    """The fields of an object that the rows have, by the document's names."""
    fields = [F.col(renamed.get(n, n)).alias(n) for n in shape.fieldNames() if renamed.get(n, n) in rows.columns]
    return F.struct(*fields)


def export_settings(settings: DataFrame) -> DataFrame:
    """One JSON object per setting (``key``, ``value``)."""
    return settings.select(F.col("key").alias("id"), F.to_json(_object(settings, SETTING)).alias("document"))


def export_clips(clips: DataFrame) -> DataFrame:
    """One JSON object per clip. The document is written as lines, so no task holds the whole catalogue."""
    renamed = {"end": "end_action"} if "end" not in clips.columns else {}
    return clips.select("id", F.to_json(_object(clips, CLIP, **renamed)).alias("document"))


def export_playlists(entries: DataFrame, playlists: DataFrame | None = None) -> DataFrame:
    """One JSON object per playlist with its entries in order and, from ``playlists`` (id, name, loop, aux), the rest.

    Lists without entries are written too. A list is one object, so its entries are gathered.
    """
    renamed = {"end": "end_action"} if "end" not in entries.columns else {}
    listed = F.sort_array(F.collect_list(F.struct("position", _object(entries, ENTRY, **renamed).alias("entry"))))
    lists = entries.groupBy(F.col("playlist").alias("id")).agg(F.transform(listed, lambda x: x["entry"]).alias("entries"))
    if playlists is None:
        return lists.select("id", F.to_json(F.struct("id", "entries")).alias("document"))
    whole = playlists.join(lists, "id", "left").withColumn("entries", F.coalesce("entries", F.array().cast(lists.schema["entries"].dataType)))
    return whole.select("id", F.to_json(_object(whole, PLAYLIST)).alias("document"))


def import_settings(documents: DataFrame, column: str = "document") -> DataFrame:
    """Settings read from JSON; objects without a key or a text value are skipped."""
    parsed = documents.select(F.from_json(column, SETTING).alias("_s")).filter("_s.key is not null and _s.value is not null")
    return parsed.select("_s.*").filter("key <> ''")


def import_playlists(documents: DataFrame, column: str = "document") -> DataFrame:
    """Playlists (id, name, loop, aux) read from JSON; a bed with a number out of range keeps all its defaults."""
    parsed = documents.select(F.from_json(column, PLAYLIST).alias("_p")).filter(F.coalesce("_p.id", F.lit("")) != "")
    good = F.lit(True)
    for name, (low, high) in AUX_RANGES.items():
        good = good & F.coalesce(F.col(f"_p.aux.{name}").between(low, high), F.lit(True))
    aux = [F.coalesce(F.when(good, F.col(f"_p.aux.{n}")), F.lit(d)).cast(AUX[n].dataType).alias(n) for n, d in AUX_DEFAULTS.items()]
    return parsed.select("_p.id", F.coalesce("_p.name", F.lit("")).alias("name"), F.coalesce("_p.loop", F.lit(False)).alias("loop"), F.struct(*aux).alias("aux"))


def import_clips(documents: DataFrame, column: str = "document") -> DataFrame:
    """Clips read from JSON: without an id they are skipped, fields that do not read get their defaults."""
    parsed = documents.withColumn("_c", F.from_json(column, CLIP, {"mode": "PERMISSIVE"})).filter(
        F.coalesce("_c.id", F.lit("")) != ""
    )
    start = F.coalesce("_c.in_ns", F.lit(0).cast("long"))
    blank = F.lit("")
    rest = [c for c in documents.columns if c != column]
    return parsed.select(
        *rest, "_c.id", F.coalesce("_c.name", blank).alias("name"), F.coalesce("_c.camera", F.lit(1)).alias("camera"),
        start.alias("in_ns"), F.coalesce("_c.out_ns", start).alias("out_ns"), F.coalesce("_c.speed", F.lit(1.0)).alias("speed"),
        *[F.coalesce(f"_c.{n}", blank).alias(n) for n in ("motion", "audio", "colour", "tags")], normalise("end_action", F.col("_c.end"))["value"].alias("end_action"),
        F.coalesce("_c.library", F.lit(False)).alias("library"), F.coalesce("_c.group", blank).alias("group"),
    )


def import_entries(documents: DataFrame, column: str = "document") -> DataFrame:
    """Playlist entries read from JSON, numbered in order; a bad transition block keeps all its defaults."""
    parsed = documents.select(F.from_json(column, PLAYLIST).alias("_p")).filter(F.coalesce("_p.id", F.lit("")) != "")
    entry = parsed.select(F.col("_p.id").alias("playlist"), F.posexplode("_p.entries").alias("position", "_e"))
    frames, audio = F.col("_e.transition_frames"), F.col("_e.audio_frames")
    kind = F.coalesce(F.col("_e.transition"), F.lit("cut"))
    good = (
        kind.isin("cut", "mix")
        & F.coalesce(frames.between(0, 250), F.lit(True))
        & F.coalesce(audio.between(-1, 250), F.lit(True))
    )
    end = normalise("end_action", F.col("_e.end"))
    length = F.when(good & (kind == "mix"), F.coalesce(F.nullif(frames, F.lit(0)), F.lit(DEFAULT_MIX_FRAMES))).otherwise(0)
    return entry.select(
        "playlist", F.col("position").cast("long").alias("position"), F.coalesce("_e.clip_id", F.lit("")).alias("clip_id"),
        F.coalesce("_e.speed", F.lit(1.0)).alias("speed"), F.when(end["ok"], end["value"]).otherwise("next").alias("end_action"),
        F.coalesce("_e.auto_advance", F.lit(True)).alias("auto_advance"), F.when(good, kind).otherwise("cut").alias("transition"),
        length.alias("transition_frames"), F.when(good, F.coalesce(audio, F.lit(-1))).otherwise(-1).alias("audio_frames"),
        F.when(good, F.coalesce("_e.own_audio", F.lit(True))).otherwise(True).alias("own_audio"),
    )


def range_changes(stored: DataFrame, imported: DataFrame) -> DataFrame:
    """Ranges an import protects, and then releases for the clips it replaces, per clip."""
    holds = (F.col("camera") == 0) | ~F.col("library")
    new = imported.filter(holds).select("id", "camera", "in_ns", "out_ns", F.lit("protect").alias("change"))
    old = stored.filter(holds).join(imported.select("id"), "id", "left_semi").select(
        "id", "camera", "in_ns", "out_ns", F.lit("release").alias("change")
    )
    return new.unionByName(old)
