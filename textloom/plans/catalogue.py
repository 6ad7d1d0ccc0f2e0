"""Every query of the library with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.plans import extensions, operations, pairs, reports, texts

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = pairs.QUERIES | reports.QUERIES | operations.QUERIES | texts.QUERIES | extensions.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
