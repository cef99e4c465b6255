"""Registered queries, each with an independently written SQL check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"query registered twice: {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return register


def load() -> dict[str, tuple[Query, str | None]]:
    from forecourt.catalog import (  # noqa: F401  (they register on import)
        aggregate_queries,
        filter_queries,
        quality_queries,
        rule_queries,
        series_queries,
        source_queries,
        stream_queries,
        text_queries,
    )
    return REGISTRY
