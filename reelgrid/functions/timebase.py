"""Time, rate and length expressions on the nanosecond timeline.

Products of nanoseconds and rates exceed 64 bits, so they are split into whole seconds (or whole rate periods) and a
remainder; every step stays inside BIGINT, is exact and compiles into generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECOND = 1_000_000_000


def _c(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value).cast("long")


def idiv(a, b) -> Column:
    """Integer division that truncates toward zero."""
    return F.call_function("div", _c(a), _c(b))


def ts_to_index(ns, num, den) -> Column:
    """Grain index of an instant, half up; null for a zero rate."""
    ns, num, den = _c(ns), _c(num).cast("long"), _c(den).cast("long")
    second = F.lit(SECOND)
    grains = idiv(ns, second) * num
    rest = (grains % den) * second + (ns % second) * num + F.lit(SECOND // 2) * den
    return F.when((num != 0) & (den != 0), idiv(grains, den) + idiv(rest, den * second))


def index_to_ts(index, num, den) -> Column:
    """Rounded start of a grain; null for a zero rate."""
    index, num, den = _c(index).cast("long"), _c(num).cast("long"), _c(den).cast("long")
    scaled = index * den
    rest = (scaled % num) * F.lit(SECOND) + idiv(num, 2)
    return F.when((num != 0) & (den != 0), idiv(scaled, num) * F.lit(SECOND) + idiv(rest, num))


def frame_period_ns(num, den) -> Column:
    num, den = _c(num).cast("long"), _c(den).cast("long")
    return F.when(num > 0, idiv(den * F.lit(SECOND) + idiv(num, 2), num)).otherwise(F.lit(0).cast("long"))


def timecode(ns, num, den, drop=False) -> Column:
    """``HH:MM:SS:FF`` of the time of day; a drop flag only changes the last separator."""
    ns, num, den = _c(ns), _c(num).cast("long"), _c(den).cast("long")
    second = idiv(ns, SECOND)
    nominal = idiv(num + idiv(den, 2), den)
    frame = F.greatest(ts_to_index(ns, num, den) - ts_to_index(second * F.lit(SECOND), num, den), F.lit(0).cast("long"))
    frame = F.when((nominal > 0) & (frame >= nominal), frame % nominal).otherwise(frame)
    mark = F.when(drop if isinstance(drop, Column) else F.lit(drop), ";").otherwise(":")
    text = F.format_string(
        "%02d:%02d:%02d%s%02d", idiv(second, 3600) % 24, idiv(second, 60) % 60, second % 60, mark, frame
    )
    return F.when((num > 0) & (den > 0), text)


def samples_until(index, num, den, sample_rate=48000) -> Column:
    """Audio samples before a frame (rounded)."""
    index, num, den = _c(index).cast("long"), _c(num).cast("long"), _c(den).cast("long")
    per = den * F.lit(sample_rate).cast("long")
    # index = a·num + b, so index·per/num = a·per + b·per/num.
    whole = idiv(index, num) * per
    return F.when(num > 0, whole + idiv((index % num) * per + idiv(num, 2), num)).otherwise(F.lit(0).cast("long"))


def samples_for_frame(index, num, den, sample_rate=48000) -> Column:
    index = _c(index).cast("long")
    return samples_until(index + 1, num, den, sample_rate) - samples_until(index, num, den, sample_rate)


def rate_token(text) -> Column:
    """A rate written as ``50``, ``30000/1001`` or one of the short broadcast names; null when it is not one."""
    text = _c(text)
    # The short names of the 1001 rates.
    short = {"2398": 24000, "23.98": 24000, "2997": 30000, "29.97": 30000, "5994": 60000, "59.94": 60000}
    named = F.create_map(*[F.lit(v) for pair in short.items() for v in pair])[text]
    number = r"^\s*([+-]?\d+)"
    slash = F.locate("/", text)
    head = F.regexp_extract(F.when(slash > 0, F.substring_index(text, "/", 1)).otherwise(text), number, 1)
    tail = F.regexp_extract(F.substr(text, slash + 1), number, 1)
    num = F.coalesce(named, head.try_cast("int"))
    den = F.when(named.isNotNull(), 1001).when(slash > 0, tail.try_cast("int")).otherwise(1)
    return F.when((num > 0) & (den > 0), F.struct(num.alias("num"), den.alias("den")))


def parse_formats(rows: DataFrame, column: str) -> DataFrame:
    """Add width, height, interlaced, num, den of a video format such as ``1080p50``, and ``error`` when refused.

    The parts are separate projections, so each is computed once and the generated code stays small.
    """
    # Rasters named by their height.
    known = {"720": (1280, 720), "1080": (1920, 1080), "2160": (3840, 2160)}
    sizes = F.create_map(
        *[v for k, (w, h) in known.items() for v in (F.lit(k), F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")))]
    )
    parts = (
        rows.withColumn("_text", F.lower(column))
        .withColumn("_part", F.split("_text", "[pi]", 2))
        .withColumn("_mode", F.regexp_extract("_text", "[pi]", 0))
        .withColumn("_raster", F.when(F.col("_mode") != "", F.col("_part")[0]).otherwise(""))
        .withColumn("_rest", F.when(F.col("_mode") != "", F.try_element_at("_part", F.lit(2))))
        .withColumn("_rest", F.when(F.col("_mode") == "i", F.regexp_replace("_rest", "tff$", "")).otherwise(F.col("_rest")))
        .withColumn("_size", sizes[F.col("_raster")])
        .withColumn("_rate", rate_token("_rest"))
        .withColumn("_w", F.coalesce("_size.w", F.regexp_extract("_raster", r"^\s*(\d+)[^x]*x", 1).try_cast("int")))
        .withColumn("_h", F.coalesce("_size.h", F.regexp_extract("_raster", r"x\s*(\d+)", 1).try_cast("int")))
    )
    mode, w, h, rate = F.col("_mode"), F.col("_w"), F.col("_h"), F.col("_rate")
    woven = ((rate["num"] == 25) & (rate["den"] == 1)) | ((rate["num"] == 30000) & (rate["den"] == 1001))
    error = (
        F.when(mode == "", "no_mode")
        .when((mode == "i") & F.endswith("_text", F.lit("bff")), "bff")
        .when(F.col("_size").isNull() & ~F.contains("_raster", F.lit("x")), "raster")
        .when(w.isNull() | h.isNull() | rate.isNull() | (w < 2) | (h < 2) | (w % 2 != 0), "format")
        .when((mode == "i") & ~((w == 1920) & (h == 1080) & woven), "interlaced")
    )
    good = F.col("error").isNull()
    return (
        parts.withColumn("error", error)
        .withColumns(
            {
                "width": F.when(good, w),
                "height": F.when(good, h),
                "interlaced": F.when(good, mode == "i"),
                "num": F.when(good, rate["num"]),
                "den": F.when(good, rate["den"]),
            }
        )
        .drop("_text", "_part", "_mode", "_raster", "_rest", "_size", "_rate", "_w", "_h")
    )


def frame_bytes(width, height, quality) -> Column:
    """Estimated stored bytes of a picture."""
    pixels = _c(width).cast("double") * _c(height).cast("double")
    q = F.when(_c(quality) <= 0, 1.0).otherwise(_c(quality).cast("double") / F.lit(92.0))
    return pixels * F.lit(0.1875) * q


def bytes_per_hour(width, height, quality, fps) -> Column:
    return frame_bytes(width, height, quality) * _c(fps).cast("double") * F.lit(3600.0)


def stretch_length(samples, speed) -> Column:
    """Output length of an audio block played at a speed."""
    rate = F.greatest(_c(speed), F.lit(1e-4))
    return F.greatest(F.lit(1).cast("long"), F.round(_c(samples).cast("double") / rate).cast("long"))
