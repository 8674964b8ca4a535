"""Registry of named queries (Spark) and oracle SQL (DuckDB)."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
BENCH: list[str] = []


def query(name: str, oracle: str | None = None, bench: bool = False):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        if bench:
            BENCH.append(name)
        return fn
    return deco


def load_all() -> None:
    from . import (cohort_queries, eval_queries, io_queries, registry_queries,  # noqa: F401
                   scoring_queries, store_queries)
