"""Registry of runnable queries and the SQL text each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under an operator name, with its SQL twin where one exists."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def load_all() -> None:
    """Import every module that registers queries."""
    from embedmap.plans import (  # noqa: F401
        curation,
        graphs,
        ingest,
        mapping,
        scope,
        search,
        text,
    )
