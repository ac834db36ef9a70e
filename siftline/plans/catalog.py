"""Registry of the queries: a Spark callable and, where one exists, equal SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `fn(spark, folder)` under a name with its checking SQL."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def r6(x: str | Column) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return F.round(c, 6)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, NaN to null, as the SQL side writes them."""
    return df.select(
        *[
            F.round(F.nanvl(F.col(n), F.lit(None).cast("double")), 6).alias(n)
            if t == "double"
            else F.col(n)
            for n, t in df.dtypes
        ]
    )


def load() -> None:
    """Import every module that registers queries."""
    from siftline.plans import (  # noqa: F401
        queries_data,
        queries_metrics,
        queries_models,
        queries_review,
        queries_text,
    )
