"""Registry of named queries: a Spark callable and, where SQL can state it, the same result in SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, bigint: str = "") -> Callable[[Query], Query]:
    """Register a query; ``bigint`` names SQL columns whose sums come out wider than a Spark long."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            casts = ", ".join(f'CAST("{c}" AS BIGINT) AS "{c}"' for c in bigint.split())
            SQL[name] = f"SELECT * REPLACE ({casts}) FROM ({sql})" if casts else sql
        return fn
    return add


def load() -> None:
    """Import every module that registers queries."""
    from parley.plans import (  # noqa: F401
        q_catches,
        q_corrections,
        q_drift,
        q_evaluate,
        q_identity,
        q_incremental,
        q_labels,
        q_overlays,
        q_names,
        q_speech,
        q_stories,
        q_text,
        q_views,
    )
