"""All registered queries of the library and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstone.sources.workspace import tidy

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if it has one; its working tables go when nothing reads them."""

    def register(run: Query) -> Query:
        _QUERIES[run.__name__] = tidy(run)
        if sql:
            _SQL[run.__name__] = sql
        return run

    return register


def _load() -> None:
    from quillstone.plans import evidence, guarding, index, ingestion, portfolio, retrieval, service, tenancy, texts, versions  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
