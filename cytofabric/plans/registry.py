"""Named queries over the driver's tables, and the SQL each must agree with."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_MODULES = ("ingest", "populations", "spatial", "clinical", "features", "gating", "metadata", "api")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query (spark, sf_dir) -> DataFrame, and the SQL for the same rows over the same tables."""

    def keep(function: Query) -> Query:
        _QUERIES[name] = function
        if sql:
            _SQL[name] = sql
        return function

    return keep


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"cytofabric.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
