"""The registry of queries: name -> (callable on a session and a data folder, SQL that gives the same rows)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, keys: list[str], columns: list[str], digits: int = 6) -> DataFrame:
    """Keys, and values rounded so that sums taken in another order compare equal (and zero has one sign)."""
    return df.select(*keys, *[(F.round(F.col(c).cast("double"), digits) + F.lit(0.0)).alias(c) for c in columns])
