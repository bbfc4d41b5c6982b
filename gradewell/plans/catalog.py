"""Registry of the engine's queries: name -> (Spark query, oracle SQL)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
#: Modules whose import registers queries.
_MODULES = ("trajectories", "scalars", "relational", "aggregates", "checks", "models", "gaps", "parts", "answers", "stored")


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Decorator: add a query and, where SQL expresses it, its oracle."""

    def add(query: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = query
        if sql:
            _ORACLES[name] = sql
        return query

    return add


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"gradewell.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
