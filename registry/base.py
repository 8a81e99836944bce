"""Registry and small helpers shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query, by default under its function name, with its oracle if any."""
    def add(fn: Query) -> Query:
        QUERIES[name or fn.__name__] = fn
        if sql is not None:
            ORACLES[name or fn.__name__] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def has(col: str, *words: str) -> str:
    """SQL: does the text hold one of the words (false when null)?"""
    test = " OR ".join(f"contains({col}, '{w}')" for w in words)
    return f"coalesce({test}, false)"


def hits(col: str, pattern: str) -> str:
    """SQL: does the text match the pattern (false when null)?"""
    return f"coalesce(regexp_matches({col}, '{pattern}'), false)"


def semis(col: str) -> str:
    """SQL: number of semicolons, null for null."""
    return f"(length({col}) - length(replace({col}, ';', '')))"
