"""Small text sources: domain definitions, flow definitions and JSON log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOMAIN = "id string, label string, mirror boolean"
FLOW = "interlace_mode string, grain_rate struct<numerator:bigint,denominator:bigint>, frame_width bigint, frame_height bigint"


def scan_registry(spark: SparkSession, root: str, name: str = "domain_def.json") -> DataFrame:
    """Domains of a directory tree, one definition file each; definitions without an id are left out."""
    found = spark.read.schema(DOMAIN).option("multiLine", True).option("pathGlobFilter", name)
    rows = found.option("recursiveFileLookup", True).json(root)
    folder = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1)
    return rows.filter(F.coalesce("id", F.lit("")) != "").select(
        folder.alias("folder"), "id", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("mirror", F.lit(False)).alias("mirror")
    )


def with_flow(rows: DataFrame, definition: Column) -> DataFrame:
    """Parse a flow definition once, as ``flow``; unreadable ones have no fields."""
    return rows.withColumn("flow", F.from_json(definition, FLOW))


def flow_compat(width: int, height: int, num: int, den: int, interlaced: bool) -> Column:
    """Why ``flow`` is not recorded in the house format (null when it is), and whether its fields are woven."""
    flow = F.col("flow")
    mode = flow["interlace_mode"]
    progressive = mode.isNull() | (mode == "progressive")
    if not interlaced:
        reason = F.when(~progressive, "interlaced")
        return F.struct(reason.alias("reason"), F.lit(False).alias("woven"))
    n, d = flow["grain_rate"]["numerator"], F.coalesce(flow["grain_rate"]["denominator"], F.lit(1))
    other_rate = F.coalesce(n * den != d * num, ~progressive)
    other_raster = F.coalesce(flow["frame_width"] != width, F.lit(False)) | F.coalesce(flow["frame_height"] != height, F.lit(False))
    reason = (
        F.when(~progressive & ~mode.isin("interlaced_tff", "interlaced_bff"), "interlaced")
        .when(~progressive & (mode == "interlaced_bff"), "interlaced_bff")
        .when(other_rate, F.when(progressive, "rate").otherwise("interlaced_rate"))
        .when(other_raster, "raster")
    )
    return F.struct(reason.alias("reason"), (reason.isNull() & ~progressive).alias("woven"))


def parse_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """Level, event and the remaining fields (as a map) of JSON log lines; other lines are left out."""
    fields = F.from_json(column, "map<string,string>")
    parsed = lines.withColumn("_f", fields).filter(F.col("_f").isNotNull() & F.map_contains_key("_f", "event"))
    rest = F.map_filter("_f", lambda k, v: ~k.isin("level", "event"))
    keys = [c for c in lines.columns if c != column]
    return parsed.select(*keys, F.col("_f")["level"].alias("level"), F.col("_f")["event"].alias("event"), rest.alias("fields"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_log(spark.read.text(path))
