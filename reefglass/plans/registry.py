"""Where the core's named queries and their SQL are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
AS_OF = "2025-01-01 00:00:00"  #: stands for now wherever a result depends on the time
AS_OF_US = 1_735_689_600_000_000


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and, where SQL can express it over whole tables, the SQL."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered already")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add
