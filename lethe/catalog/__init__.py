"""Every operator as a named query over the given tables, with its check in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without SQL its rows are only counted by the driver."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def load() -> None:
    from lethe.catalog import (  # noqa: F401
        certificates,
        graph,
        jobs,
        requests,
        streams,
        telemetry,
        triplets,
        vectors,
    )
