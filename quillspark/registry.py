"""All queries over the reference operators, by key, with their DuckDB counterparts."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("relational", "joins", "aggregates", "windows", "sets", "scalars", "classify", "retrieval", "extraction", "chunking", "graph", "verify", "sinks", "files", "streams")

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under an operator's key; sql: the same result in DuckDB, None where SQL cannot state it."""

    def add(f):
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return add


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"quillspark.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(sorted(_queries.items()))


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(sorted(_sql.items()))
