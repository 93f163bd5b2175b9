"""Registered queries: name -> (function of (spark, sf_dir), SQL that DuckDB runs over the same tables, or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        REGISTRY[name] = (function, sql)
        return function

    return add
