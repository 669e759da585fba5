"""The asset-by-date panel: a weekly bar table derived from the order lines.

An asset is a supplier, its market the region, its industry the nation. Prices are unit prices of the week's lines. Sums
are exact decimals, so bars do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BAR_COLUMNS = ["asset_id", "market", "industry", "date", "open", "high", "low", "close", "adj_close", "volume", "amount", "vwap"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset_id, market, industry."""
    nation = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    suppliers = read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return suppliers.select(F.col("s_suppkey").alias("asset_id"), F.col("r_name").alias("market"), F.col("n_name").alias("industry"))


#: Order lines (about half as many bars) in a partition of a large panel.
PART_LINES = 100_000


def parts(spark: SparkSession, sf_dir: str) -> int | None:
    """Partitions of a panel, in step with its order lines (counted from the files' footers); None for a small one."""
    n = -(-read(spark, sf_dir, "lineitem").count() // PART_LINES)
    return n if n > 16 else None


def by_asset(lines: DataFrame, n: int | None) -> DataFrame:
    """Order lines dealt by asset, in n partitions or as the session sets it."""
    return lines.repartition(n, "l_suppkey") if n else lines.repartition("l_suppkey")


def bars(spark: SparkSession, sf_dir: str, more: dict[str, Column] | None = None) -> DataFrame:
    """The panel, its rows dealt by asset: windows by asset need no further exchange.

    more: further sums of a bar's order lines, by name, so that a side table of them needs no scan and join of its own.
    """
    more = more or {}
    lines = by_asset(read(spark, sf_dir, "lineitem"), parts(spark, sf_dir))
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    weekly = lines.groupBy(F.col("l_suppkey").alias("asset_id"), F.date_trunc("week", "l_shipdate").cast("date").alias("date")).agg(
        F.round(F.avg(unit), 10).alias("open"),
        F.max(unit).alias("high"),
        F.min(unit).alias("low"),
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("volume"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("amount"),
        *[c.alias(n) for n, c in more.items()],
    )
    price = F.col("amount") / F.col("volume")
    return weekly.withColumns({"close": price, "adj_close": price, "vwap": price}).join(assets(spark, sf_dir), "asset_id").select(*BAR_COLUMNS, *more)
