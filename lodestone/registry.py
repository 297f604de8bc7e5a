"""Registry of queries: name -> (builder, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


class Query(NamedTuple):
    build: Build
    sql: str | None


_QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a builder under ``name``; ``sql`` is its DuckDB equivalent."""

    def keep(build: Build) -> Build:
        if name in _QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        _QUERIES[name] = Query(build, sql)
        return build

    return keep


def _load() -> dict[str, Query]:
    from lodestone import plans

    plans.load()
    return _QUERIES


def queries() -> dict[str, Build]:
    return {name: q.build for name, q in _load().items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in _load().items() if q.sql is not None}
