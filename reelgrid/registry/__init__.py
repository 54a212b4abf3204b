"""Named queries over the supplied tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from reelgrid.registry.tables import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Register a function of :class:`Tables`; ``views`` names the fixture views its SQL uses."""

    def add(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = with_views(views, sql)
        return build

    return add


# The modules that register queries, in the order they are listed.
MODULES = "q_time q_sources q_store q_ingest q_joins q_playout q_signal q_catalog q_metrics q_streams".split()


def load() -> None:
    for module in MODULES:
        import_module(f"reelgrid.registry.{module}")
