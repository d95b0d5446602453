"""Collects the queries that ``__spark_entry__`` offers: name, Spark function, SQL for the check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register ``f(spark, sf_dir)`` under its own name, with DuckDB SQL for the same rows."""

    def add(f):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add
