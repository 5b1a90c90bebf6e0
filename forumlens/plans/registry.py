"""Registered queries (name -> callable(spark, sf_dir)) and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers the decorated function under `name`, with its oracle if SQL can express it."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# The modules below register their queries when they are imported.
from forumlens.plans import aggregations, enrichment, panels, records, search, streams  # noqa: E402, F401
