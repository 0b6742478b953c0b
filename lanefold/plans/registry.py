"""Name to query. A query takes the session and the folder of the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that gives the same rows where SQL can say it."""
    if name in _queries:
        raise ValueError(f"query {name!r} is already registered")

    def keep(fn: Query) -> Query:
        _queries[name] = fn
        if sql is not None:
            _sql[name] = sql
        return fn

    return keep


def registered() -> dict[str, Query]:
    return dict(_queries)


def oracles() -> dict[str, str]:
    return dict(_sql)


def known() -> list[str]:
    return sorted(_queries)


def resolve(name: str) -> Query:
    if name not in _queries:
        raise KeyError(f"unknown query {name!r}; known: {', '.join(known())}")
    return _queries[name]
