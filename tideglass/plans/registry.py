"""Named queries over the driver's tables, each with its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def uuid5_sql(sha1: str) -> str:
    """DuckDB's expression for the name-based UUID of a SHA-1 in hexadecimal digits."""
    variant = f"substr('89ab', (instr('0123456789abcdef', substr({sha1}, 17, 1)) - 1) % 4 + 1, 1)"
    return f"substr({sha1}, 1, 8) || '-' || substr({sha1}, 9, 4) || '-5' || substr({sha1}, 14, 3) || '-' || {variant} || substr({sha1}, 18, 3) || '-' || substr({sha1}, 21, 12)"
