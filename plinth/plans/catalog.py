"""The query catalogue: each entry is a DataFrame plan and, where SQL can say it, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from plinth.sources.tables import Tables

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register plan(tables) -> DataFrame under a name, with its SQL."""

    def add(plan: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered already")
        QUERIES[name] = lambda spark, folder: plan(Tables(spark, folder))
        if sql:
            SQL[name] = sql
        return plan

    return add


def load() -> None:
    """Import the modules that register queries."""
    from plinth.plans import aggregates, evaluation, extended, features, learning, more, profiling, relational, scenarios, series  # noqa: F401
