"""Runnable queries over the benchmark tables, one per operator, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say the same, its counterpart."""
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def load_all() -> tuple[dict[str, Query], dict[str, str]]:
    from policyspark.catalog import documents, evaluation, labels, reports, roundtrips, streams, web  # noqa: F401

    return dict(QUERIES), dict(SQL)
