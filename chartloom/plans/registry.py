"""Registry of queries and the SQL that states their expected result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
CHECK_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query under its function name, with its check where SQL can express it."""

    def add(fn: QueryFn) -> QueryFn:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            CHECK_SQL[key] = sql
        return fn

    return add
