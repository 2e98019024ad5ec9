"""Registry of named queries and the SQL that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
MODULES = [
    "ranking_queries",
    "career_queries",
    "history_queries",
    "rating_queries",
    "match_queries",
    "identity_queries",
    "outcome_queries",
    "snapshot_queries",
    "gate_queries",
    "function_queries",
    "page_queries",
]


def query(name: str, sql: str | None = None):
    """Register a ``(spark, folder) -> DataFrame`` function, with its checking SQL if there is one."""

    def add(build: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return add


def load_all() -> None:
    """Import every query module once."""
    for module in MODULES:
        importlib.import_module(f"{__package__}.{module}")
