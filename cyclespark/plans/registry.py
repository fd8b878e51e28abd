"""Registered queries of the telemetry operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, places: int = 4) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal; -0.0 becomes 0.0."""
    return df.withColumns({c: F.round(c, places) + 0.0 for c in columns})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["flagship_life_labels"](spark, sf_dir)


def queries() -> dict[str, Query]:
    from . import evaluation_queries, telemetry_queries  # noqa: F401  register on import

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
