"""Registry of named queries: a Spark builder plus, where SQL can say the same
thing, an independent DuckDB oracle statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from tabulon.plans import (q_relational, q_profile, q_quality, q_stats,  # noqa: F401
                               q_charts, q_explore, q_extract, q_udf, q_flows, q_series)
