"""Financial statements with two times: the period they are of, and the day they were announced.

Rows are read as of a date: what was announced later does not exist, a revision displaces what it revises from its own
announcement on, and a lower kind of report never displaces a higher one.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATEMENT_KEYS = ["symbol", "ann_date", "end_date", "report_type", "comp_type", "end_type"]


def merge_statements(parts: dict[str, DataFrame], values: dict[str, list[str]], version: str, keys: list[str] = STATEMENT_KEYS) -> DataFrame:
    """One row per key with the values of every statement, NULL where one has no row: an outer join of deduplicated parts.

    Of several rows of a key in one part the one of the greatest version counts, whole. The parts are put under each other
    and aggregated once, so there is one shuffle, with partial sums, however many parts there are. NULL keys are keys.
    """
    together: DataFrame | None = None
    for name, frame in parts.items():
        row = F.struct(F.col(version).alias("version"), *values[name])
        own = frame.select(*keys, *[(row if n == name else F.lit(None).cast(_row_type(parts[n], version, values[n]))).alias(f"__{n}") for n in parts])
        together = own if together is None else together.unionByName(own)
    if together is None:
        raise ValueError("no statements to merge")
    last = together.groupBy(*keys).agg(*[F.max(f"__{n}").alias(f"__{n}") for n in parts])
    return last.select(*keys, *[F.col(f"__{n}.{v}").alias(v) for n in parts for v in values[n]])


def _row_type(frame: DataFrame, version: str, values: list[str]) -> str:
    types = dict(frame.dtypes)
    return f"struct<version:{types[version]},{','.join(f'{v}:{types[v]}' for v in values)}>"


def known_versions(statements: DataFrame, precedence: Column, entity: list[str], period: str = "end_date", known: str = "ann_date") -> DataFrame:
    """Statements that ever were the best known of their period, with ``known_from`` and ``known_to`` (NULL while in force).

    The best of those announced by a day has the least ``precedence`` and, among these, the latest announcement. Rows of one
    period are one ordered stream; a row counts if none before it has a lesser precedence, until the next one that counts.
    """
    of = Window.partitionBy(*entity, period)
    ranked = statements.withColumn("__rank", precedence).where(F.col(known).isNotNull())
    # one row a day: the least precedence of the day
    day = Window.partitionBy(*entity, period, known).orderBy("__rank", *[F.col(c) for c in STATEMENT_KEYS if c in statements.columns])
    daily = ranked.withColumn("__at", F.row_number().over(day)).where("__at = 1")
    so_far = F.min("__rank").over(of.orderBy(known).rowsBetween(Window.unboundedPreceding, 0))
    counts = daily.withColumn("__best", so_far).where("__rank = __best")
    return counts.withColumns({"known_from": F.col(known), "known_to": F.lead(known).over(of.orderBy(known))}).drop("__rank", "__at", "__best")


def as_of(versions: DataFrame, dates: list[dt.date]) -> DataFrame:
    """The versions in force on each of a few dates, with ``as_of``."""
    days = F.array(*[F.lit(d) for d in dates])
    inside = lambda d: (d >= F.col("known_from")) & (F.col("known_to").isNull() | (d < F.col("known_to")))
    return versions.withColumn("as_of", F.explode(F.filter(days, inside)))
