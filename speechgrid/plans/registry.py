"""Registration of named queries with the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import Tables, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, **views: str):
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``oracle`` is the comparison SQL (derived views are added as
    CTEs)."""
    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = lambda spark, path: fn(Tables(spark, path))
        if oracle is not None:
            ORACLES[name] = sql(oracle, **views)
        return fn
    return keep
