"""Registered queries: each a Spark callable and, where SQL can say it, the same question for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
MODULES = ["cleaning", "telemetry", "evaluation", "splits", "detectors", "live", "files", "evaluations"]


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its oracle SQL if there is one."""
    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def load() -> tuple[dict[str, Query], dict[str, str]]:
    for module in MODULES:
        import_module(f"pollwarden.catalog.{module}")
    return dict(QUERIES), dict(ORACLES)
