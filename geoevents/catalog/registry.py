"""Named queries over the supplied tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geoevents.catalog import ctes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_SQL: dict[str, tuple[str, str]] = {}


def query(name: str, sql: str | None = None, needs: str = ""):
    """Register a query; ``needs`` names the shared table expressions its SQL starts from."""
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = (needs, sql)
        return fn

    return register


def oracles() -> dict[str, str]:
    """Query name -> complete SQL."""
    return {name: ctes.with_tables(needs, sql) for name, (needs, sql) in _SQL.items()}
