"""Session and comparison helpers for tests, the checker and the benchmark."""

from __future__ import annotations

import math
import os
from collections import Counter

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def session(cpus: str | None = None) -> SparkSession:
    cores = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("reelgrid")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def open_duckdb(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


_KINDS = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "float": "FLOAT",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def compare(result: DataFrame, duck, sql: str | None) -> str | None:
    """None when rows, column names and column types agree; else what differs."""
    names = sorted(result.columns)
    rows = [tuple(_plain(row[n]) for n in names) for row in result.collect()]
    if sql is None:
        return f"rows only: {len(rows)}"
    relation = duck.sql(sql)
    columns = list(relation.columns)
    if sorted(columns) != names:
        return f"columns {names} vs {sorted(columns)}"
    place = [columns.index(n) for n in names]
    expected = [tuple(_plain(row[i]) for i in place) for row in relation.fetchall()]
    types = dict(result.dtypes)
    kinds = dict(zip(columns, map(str, relation.types)))
    wrong = [(n, types[n], kinds[n]) for n in names if _KINDS.get(types[n], types[n]) != kinds[n]]
    if wrong:
        return f"types {wrong}"
    if not rows:
        return "no rows on either side" if not expected else f"no rows, expected {len(expected)}"
    mine, theirs = Counter(rows), Counter(expected)
    if mine != theirs:
        extra, lost = list((mine - theirs).elements()), list((theirs - mine).elements())
        key = lambda r: tuple(map(str, r))
        return (
            f"{len(rows)} vs {len(expected)} rows, {len(extra)} differ; {names} "
            f"got {sorted(extra, key=key)[:3]} want {sorted(lost, key=key)[:3]}"
        )
    return None
