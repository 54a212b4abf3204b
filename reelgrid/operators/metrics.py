"""Counters, gauges, histograms and what is read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.plans.ordered import over_timeline, previous_row, running, running_count, spread

# Upper bounds of the latency buckets in seconds.
BOUNDS = (0.001, 0.002, 0.005, 0.008, 0.012, 0.020, 0.040)


def label_text(labels) -> Column:
    """``{a="1",b="2"}`` with the labels in name order; empty without labels."""
    pairs = F.transform(
        F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))
    )
    return F.when(F.size(labels) == 0, "").otherwise(F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")))


def counters(increments: DataFrame, keys: list[str]) -> DataFrame:
    return increments.groupBy(*keys).agg(F.sum("value").alias("value"))


def gauges(sets: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last value set of each series."""
    return sets.groupBy(*keys).agg(F.max_by("value", order).alias("value"))


def zero_fill(values: DataFrame, dimensions: dict[str, list], column: str) -> DataFrame:
    """Every series of the declared label values, 0 where nothing was counted. The label values are a fixed list."""
    names = list(dimensions)
    series = values.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, dimensions[names[0]]))).alias(names[0]))
    for name in names[1:]:
        series = series.withColumn(name, F.explode(F.array(*map(F.lit, dimensions[name]))))
    return series.join(values, names, "left").fillna({column: 0})


def histogram(observations: DataFrame, keys: list[str], value: str, bounds=BOUNDS) -> DataFrame:
    """Cumulative buckets (``le``, null for the last), with the sum and count of the series on every row."""
    below = [F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(bounds)]
    totals = observations.groupBy(*keys).agg(*below, F.sum(value).alias("total"), F.count(value).alias("count"))
    rows = [F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("bucket")) for i, b in enumerate(bounds)]
    rows.append(F.struct(F.lit(None).cast("double").alias("le"), F.col("count").alias("bucket")))
    return totals.select(*keys, "total", "count", F.explode(F.array(*rows)).alias("_r")).select(
        *keys, "_r.le", "_r.bucket", "total", "count"
    )


def _quantile(buckets: list[Column], all_of: Column, q: float, bounds) -> Column:
    """Linear inside the first bucket that reaches the quantile; the last bound beyond all of them, null of nothing."""
    rank = all_of * F.lit(q)
    found = F.lit(float(bounds[-1]))
    for i in reversed(range(len(bounds))):
        low, before = (bounds[i - 1], buckets[i - 1]) if i else (0.0, F.lit(0))
        share = (rank - before) / (buckets[i] - before)
        inside = F.lit(float(low)) + F.when(buckets[i] > before, share).otherwise(1.0) * F.lit(bounds[i] - low)
        found = F.when(buckets[i] >= rank, inside).otherwise(found)
    return F.when(all_of > 0, found)


def histogram_quantile(observations: DataFrame, keys: list[str], value: str, q: float, bounds=BOUNDS) -> DataFrame:
    """Quantile of observations from their buckets."""
    below = [F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(bounds)]
    totals = observations.groupBy(*keys).agg(*below, F.count(value).alias("_n"))
    return totals.select(*keys, _quantile([F.col(f"_b{i}") for i in range(len(bounds))], F.col("_n"), q, bounds).alias("quantile"))


def bucket_samples(observations: DataFrame, keys: list[str], order: list[str], value: str, restarts: str | None = None, bounds=BOUNDS) -> DataFrame:
    """What a scrape of the buckets reads after each observation: ``le`` (null for the last) and the count so far.

    With ``restarts``, a flag on the rows before which the process starts anew and counts from zero.
    """
    cut = spread(observations, keys, order)
    generation = running_count(F.col(restarts)) if restarts else running_count(F.lit(False))
    lived = running(cut, keys, order, _life=generation)
    within = [*keys, "_life"]
    counts = {f"_b{i}": running_count(F.col(value) <= b) for i, b in enumerate(bounds)}
    counted = running(lived, within, order, again=True, **counts, _all=running_count())
    rows = [F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("value")) for i, b in enumerate(bounds)]
    rows.append(F.struct(F.lit(None).cast("double").alias("le"), F.col("_all").alias("value")))
    return counted.select(*keys, *order, F.explode(F.array(*rows)).alias("_s")).select(*keys, *order, "_s.le", "_s.value")


def bucket_rates(samples: DataFrame, series: list[str], order: list[str], keys: list[str], window: str, slide: str) -> DataFrame:
    """Increases of bucket counters over a sliding window, summed by ``keys`` and ``le``.

    ``samples``: series, le, ``ts_us`` first in ``order``, value. A counter that falls has restarted from zero. The
    increases of any series add up, so they are reduced before they are shuffled.
    """
    named = samples.withColumn("_le", F.coalesce(F.col("le"), F.lit(float("inf"))))
    seen = over_timeline(named, [*series, "_le"], order, _was=previous_row("value"))
    step = F.when(F.col("value") >= F.col("_was.value"), F.col("value") - F.col("_was.value")).when(F.col("_was").isNotNull(), F.col("value"))
    sliding = F.window(F.timestamp_micros("ts_us"), window, slide)
    per = seen.groupBy(*keys, "le", sliding.alias("_w")).agg(F.sum(F.coalesce(step, F.lit(0).cast("long"))).alias("increase"))
    return per.select(*keys, "le", F.unix_micros("_w.start").alias("start_us"), "increase")


def quantile_of_rates(rates: DataFrame, keys: list[str], q: float, bounds=BOUNDS) -> DataFrame:
    """The quantile of each window from its buckets' increases; null where nothing was counted."""
    at = [F.sum(F.when(F.col("le") == float(b), F.col("increase"))).alias(f"_b{i}") for i, b in enumerate(bounds)]
    wide = rates.groupBy(*keys, "start_us").agg(*at, F.sum(F.when(F.col("le").isNull(), F.col("increase"))).alias("_n"))
    return wide.select(*keys, "start_us", _quantile([F.col(f"_b{i}") for i in range(len(bounds))], F.col("_n"), q, bounds).alias("quantile"))


def rate(samples: DataFrame, key: str, window: str, slide: str, seconds: float) -> DataFrame:
    """Per-second increase of a counter over a sliding window; a drop in value is a restart from zero."""
    seen = over_timeline(samples, [key], ["ts_us"], _was=previous_row("value"))
    step = F.when(F.col("value") >= F.col("_was.value"), F.col("value") - F.col("_was.value")).when(
        F.col("_was").isNotNull(), F.col("value")
    )
    sliding = F.window(F.timestamp_micros("ts_us"), window, slide)
    return (
        seen.groupBy(key, sliding.alias("_w"))
        .agg(F.sum(F.coalesce(step, F.lit(0.0))).alias("_gain"))
        .select(key, F.unix_micros("_w.start").alias("start_us"), (F.col("_gain") / seconds).alias("per_second"))
    )


def ahead_ratio(asked: DataFrame) -> DataFrame:
    """Hits, late and missed frames of each channel's look-ahead; waits count only for planned frames."""
    waited = F.when(F.col("planned"), F.col("waited"))
    counts = asked.groupBy("channel").pivot("result", ["hit", "late", "miss"]).agg(F.count(F.lit(1))).fillna(0)
    waits = asked.groupBy("channel").agg(F.count(waited).alias("waits"), F.coalesce(F.sum(waited), F.lit(0.0)).alias("waited"))
    return counts.join(waits, "channel")


def ahead_waits(asked: DataFrame, bounds=BOUNDS) -> DataFrame:
    """Buckets of the time each channel's planned frames were waited for."""
    return histogram(asked.filter("planned"), ["channel"], "waited", bounds)


def number(value) -> Column:
    """A number as text: whole numbers without a point, others with six places."""
    fixed = F.col(value).cast("decimal(28,6)") if isinstance(value, str) else value.cast("decimal(28,6)")
    return F.regexp_replace(F.regexp_replace(fixed.cast("string"), r"0+$", ""), r"\.$", "")


def exposition(counted: DataFrame, observations: DataFrame, prefix: str, value: str = "secs") -> DataFrame:
    """Text lines of counters and histograms: (series, place, line); the writer orders by series and place.

    ``counted``: name, labels, value; ``observations``: name, labels and the observed value. A histogram is listed
    as its cumulative buckets, the one without bound, then sum and count.
    """
    head = F.lit(f"{prefix}_")
    text = label_text(F.col("labels"))
    plain = counted.select(
        F.concat(F.lit("0"), "name", text).alias("series"), F.lit(0).alias("place"),
        F.concat(head, "name", text, F.lit(" "), number("value")).alias("line"),
    )
    keyed = observations.select("name", text.alias("_text"), value)
    rows = histogram(keyed, ["name", "_text"], value)
    extra = F.expr("substring(_text, 2, length(_text) - 2)")
    more = F.when(extra == "", "").otherwise(F.concat(F.lit(","), extra))
    bound = F.coalesce(number("le"), F.lit("+Inf"))
    series = F.concat(F.lit("1"), "name", "_text").alias("series")
    buckets = rows.select(
        series, F.coalesce((F.col("le") * 1e6).cast("int"), F.lit(2_000_000_000)).alias("place"),
        F.concat(head, "name", F.lit('_bucket{le="'), bound, F.lit('"'), more, F.lit("} "), number("bucket")).alias("line"),
    )
    last = rows.filter("le is null")
    ends = [
        last.select(series, F.lit(at).alias("place"), F.concat(head, "name", F.lit(f"_{n}"), "_text", F.lit(" "), number(c)).alias("line"))
        for at, n, c in ((2_000_000_001, "sum", "total"), (2_000_000_002, "count", "count"))
    ]
    return plain.unionByName(buckets).unionByName(ends[0]).unionByName(ends[1])
