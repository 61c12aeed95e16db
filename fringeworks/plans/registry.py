"""Registry of the catalogue's queries: a DataFrame plan and, where SQL can express it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def r(expression: str, digits: int = 6) -> str:
    """SQL text of scalar.rnd."""
    return f"(round({expression} + 1e-9, {digits}) + 0.0)"
