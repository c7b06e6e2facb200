"""The queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say the same, its counterpart."""
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def load_all() -> tuple[dict[str, Query], dict[str, str]]:
    """All queries (name to function) and the SQL of those that have one."""
    from policyspark.llm import (  # noqa: F401
        decontaminate, embedding_dedup, hard_negatives, language, lm, manifest, neighbours, packing, quality, simhash, substrings,
        tokens, urlfilter)

    import corpus_pipeline

    queries = QUERIES | {"pipeline": corpus_pipeline.run}
    return queries, SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
