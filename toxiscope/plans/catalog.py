"""Registry of named queries: ``key -> (spark, sf_dir) -> DataFrame`` plus
the DuckDB SQL that checks it (absent for rows-only checks)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return register


def load_all() -> None:
    """Import the modules that register queries."""
    from toxiscope.plans import (  # noqa: F401
        corpus_queries, model_queries, eval_queries, scoring_queries, file_queries, ablation_queries)
