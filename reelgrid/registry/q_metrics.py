"""Counters, histograms and rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgrid.operators import metrics as mt
from reelgrid.plans.ordered import running, running_count, spread
from reelgrid.registry import query

BUCKETS = "(0.001, 0.001), (0.002, 0.002), (0.005, 0.005), (0.008, 0.008), (0.012, 0.012), (0.02, 0.02), (0.04, 0.04), (null, 1e9)"


@query(
    "counter_agg",
    """select 'counter' kind, channel, stage, round(sum(secs),6) as value from metrics group by all
    union all select 'gauge', channel, stage, round(arg_max(secs, ts_us),6) from metrics group by all""",
    "metrics",
)
def _(t):
    rows = t.metrics.withColumnRenamed("secs", "value")
    total = mt.counters(rows, ["channel", "stage"]).withColumn("kind", F.lit("counter"))
    last = mt.gauges(rows, ["channel", "stage"], "ts_us").withColumn("kind", F.lit("gauge"))
    return total.unionByName(last).withColumn("value", F.round("value", 6))


@query(
    "zero_fill",
    """with d as (select cast(c as int) channel, s stage from range(1,6) a(c), (values ('render'), ('publish'), ('decode')) b(s))
    select d.channel, d.stage, count(m.secs) as value from d left join metrics m on m.channel=d.channel and m.stage=d.stage group by all""",
    "metrics",
)
def _(t):
    counts = t.metrics.groupBy("channel", "stage").agg(F.count("*").alias("value"))
    return mt.zero_fill(counts, {"channel": [1, 2, 3, 4, 5], "stage": ["render", "publish", "decode"]}, "value")


@query(
    "histogram",
    f"""with b as (select cast(le as double) le, cast(lim as double) lim from (values {BUCKETS}) v(le, lim)), m as (select *, secs*5 s5 from metrics),
    g as (select channel, stage, round(sum(s5),6) total, count(*) "count" from m group by all)
    select g.channel, g.stage, b.le, count(*) filter (m.s5<=b.lim) bucket, g.total, g."count" from g join m using (channel, stage), b group by all""",
    "metrics",
)
def _(t):
    rows = mt.histogram(t.metrics.withColumn("s5", F.col("secs") * 5), ["channel", "stage"], "s5")
    return rows.withColumn("total", F.round("total", 6))


@query(
    "rate",
    """with l as (select camera, tai_ns//1000 ts_us, payload_bytes v, lag(payload_bytes) over (partition by camera order by tai_ns) p from frames),
    s as (select camera, ts_us, cast(case when v>=p then v-p when p is not null then v else 0 end as double) g from l),
    w as (select camera, (ts_us//900000000-k)*900000000 start_us, g from s, range(4) r(k))
    select camera, start_us, round(sum(g)/3600.0,6) per_second from w group by all""",
    "frames",
)
def _(t):
    samples = t.frames.selectExpr("camera", "tai_ns div 1000 ts_us", "cast(payload_bytes as double) value")
    return mt.rate(samples, "camera", "1 hour", "15 minutes", 3600.0).withColumn("per_second", F.round("per_second", 6))


@query(
    "histogram_quantile",
    """with b as (select * from (values (0, 0.0, 0.001), (1, 0.001, 0.002), (2, 0.002, 0.005), (3, 0.005, 0.008), (4, 0.008, 0.012), (5, 0.012, 0.02), (6, 0.02, 0.04)) v(i, lo, hi)),
    n as (select stage, channel, count(*) n from metrics group by all),
    c as (select stage, channel, i, cast(lo as double) lo, cast(hi as double) hi, count(*) filter (secs*4<=hi) cum, count(*) filter (i>0 and secs*4<=lo) bef from metrics, b group by all),
    f as (select c.*, n.n, row_number() over (partition by stage, channel order by i) rn from c join n using (stage, channel) where cum>=0.95*n)
    select n.stage, n.channel, round(coalesce(lo+(0.95*n.n-bef)/(cum-bef)*(hi-lo), 0.04),6) quantile from n left join f on f.stage=n.stage and f.channel=n.channel and rn=1""",
    "metrics",
)
def _(t):
    rows = mt.histogram_quantile(t.metrics.withColumn("s4", F.col("secs") * 4), ["stage", "channel"], "s4", 0.95)
    return rows.withColumn("quantile", F.round("quantile", 6))


# Each series counts on from its last scrape, but every 40th observation follows a restart.
@query(
    "quantile_of_rates",
    f"""with b as (select cast(le as double) le, cast(lim as double) lim from (values {BUCKETS}) v(le, lim)),
    n as (select *, row_number() over (partition by channel, stage order by ts_us, event_id) n from metrics), l as (select *, n//40 life from n),
    c as (select channel, stage, ts_us, event_id, life, b.le, count(*) filter (secs*4<=b.lim) over (partition by channel, stage, life, b.lim order by ts_us, event_id) v from l, b),
    p as (select *, lag(v) over (partition by channel, stage, le order by ts_us, event_id) w from c),
    i as (select stage, le, ts_us, case when v>=w then v-w when w is not null then v else 0 end inc from p),
    r as (select stage, le, (ts_us//3600000000-k)*3600000000 start_us, cast(sum(inc) as bigint) inc from i, range(6) r(k) group by all),
    q as (select x.stage, x.start_us, x.le hi, x.inc cum, t.inc n, coalesce(lag(x.le) over w, 0) lo, coalesce(lag(x.inc) over w, 0) bef, x.inc>=cast(0.95 as double)*t.inc reached
        from r x join r t on t.stage=x.stage and t.start_us=x.start_us and t.le is null where x.le is not null window w as (partition by x.stage, x.start_us order by x.le)),
    f as (select *, row_number() over (partition by stage, start_us order by hi) rn from q where reached)
    select t.stage, t.start_us, case when t.inc>0 then round(coalesce(lo+case when cum>bef then (cast(0.95 as double)*n-bef)/(cum-bef) else 1 end*(hi-lo), 0.04),6) end quantile
        from r t left join f on f.stage=t.stage and f.start_us=t.start_us and rn=1 where t.le is null""",
    "metrics",
)
def _(t):
    rows = t.metrics.withColumn("s4", F.col("secs") * 4)
    series, order = ["channel", "stage"], ["ts_us", "event_id"]
    cut = spread(rows, series, order)
    numbered = running(cut, series, order, _n=running_count())
    scraped = mt.bucket_samples(numbered.drop("_chunk").withColumn("fresh", F.col("_n") % 40 == 0), series, order, "s4", "fresh")
    rates = mt.bucket_rates(scraped, series, order, ["stage"], "6 hours", "1 hour")
    return mt.quantile_of_rates(rates, ["stage"], 0.95).withColumn("quantile", F.round("quantile", 6))


ASKED = """with a as (select cast(user_id%3+1 as int) channel, event_id%4<>0 planned, value/10000 w from events)"""


@query(
    "ahead_waits",
    f"""{ASKED}, b as (select cast(le as double) le, cast(lim as double) lim from (values {BUCKETS}) v(le, lim)), p as (select * from a where planned),
    g as (select channel, round(sum(w),6) total, count(*) "count" from p group by 1)
    select g.channel, b.le, count(*) filter (w<=b.lim) bucket, g.total, g."count" from g join p using (channel), b group by all""",
)
def _(t):
    asked = t.events.selectExpr("cast(user_id % 3 + 1 as int) channel", "event_id % 4 <> 0 planned", "value / 10000 waited")
    return mt.ahead_waits(asked).withColumn("total", F.round("total", 6))


@query(
    "ahead_ratio",
    """with a as (select cast(user_id%3+1 as int) channel, case when event_type in ('view','click','signup') then 'hit' when event_type='error' then 'late' else 'miss' end r,
        event_id%4<>0 planned, value/1000 w from events)
    select channel, count(*) filter (r='hit') hit, count(*) filter (r='late') late, count(*) filter (r='miss') miss, count(*) filter (planned) waits,
        round(sum(case when planned then w else 0 end),6) waited from a group by 1""",
)
def _(t):
    asked = t.events.selectExpr(
        "cast(user_id % 3 + 1 as int) channel",
        "case when event_type in ('view', 'click', 'signup') then 'hit' when event_type = 'error' then 'late' else 'miss' end result",
        "event_id % 4 <> 0 planned", "value / 1000 waited",
    )
    return mt.ahead_ratio(asked).withColumn("waited", F.round("waited", 6))


NUM = "regexp_replace(regexp_replace(cast(cast({x} as decimal(28,6)) as varchar), '0+$', ''), '\\.$', '')"


@query(
    "metrics_exposition",
    f"""with l as (select name, '{{channel="'||channel||'",stage="'||stage||'"}}' lab, secs*5 s from metrics),
    b as (select cast(le as double) le, cast(lim as double) lim from (values {BUCKETS}) v(le, lim)), g as (select name, lab, sum(s) t, count(*) n from l group by all)
    select 'studio_frames_total{{camera="'||camera||'"}} '||{NUM.format(x='count(*)')} line from frames group by camera
    union all select 'studio_'||l.name||'_bucket{{le="'||coalesce({NUM.format(x='b.le')},'+Inf')||'",'||lab[2:-2]||'}} '||{NUM.format(x='count(*) filter (s<=lim)')} from l, b group by l.name, lab, b.le
    union all select 'studio_'||name||'_sum'||lab||' '||{NUM.format(x='t')} from g union all select 'studio_'||name||'_count'||lab||' '||{NUM.format(x='n')} from g""",
    "metrics frames",
)
def _(t):
    counted = t.frames.groupBy("camera").agg(F.count("*").alias("value")).select(
        F.lit("frames_total").alias("name"), F.create_map(F.lit("camera"), F.col("camera").cast("string")).alias("labels"), "value"
    )
    labels = F.create_map(F.lit("stage"), "stage", F.lit("channel"), F.col("channel").cast("string"))
    observed = t.metrics.select("name", labels.alias("labels"), (F.col("secs") * 5).alias("secs"))
    return mt.exposition(counted, observed, "studio").orderBy("series", "place").select("line")
