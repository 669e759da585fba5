"""Checks of the panel: rules, gaps, stale runs, price jumps, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as w
from .labels import sessions


def violations(bars: DataFrame) -> DataFrame:
    """One row per asset: how many of its bars break each rule; one pass, one aggregate."""
    some = lambda c: F.count_if(c)
    prices = ["open", "high", "low", "close", "adj_close"]
    null = F.lit(False)
    for c in [*prices, "volume", "amount"]:
        null = null | F.col(c).isNull()
    negative = F.least(*prices, "volume", "amount") < 0
    order = (F.col("high") < F.greatest("open", "low", "close")) | (F.col("low") > F.least("open", "high", "close"))
    repeats = F.count(F.lit(1)) - F.count_distinct("date")
    return bars.groupBy("asset_id", "market").agg(F.count(F.lit(1)).alias("bars"), some(null).alias("nulls"), some(negative).alias("negative"), some(order).alias("bad_order"), some(F.col("volume") == 0).alias("no_volume"), repeats.alias("repeats"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def gaps(bars: DataFrame) -> DataFrame:
    """Market sessions within an asset's life on which it has no bar."""
    days = sessions(bars)
    life = bars.groupBy("asset_id", "market").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    due = life.join(days.select("market", "date"), "market").where("date between first and last").select("asset_id", "market", "date")
    return due.join(bars.select("asset_id", "date"), ["asset_id", "date"], "left_anti")


def runs(bars: DataFrame, value: str, least: int) -> DataFrame:
    """Runs of at least ``least`` consecutive bars with one value: gaps and islands."""
    order = w.by_asset()
    changed = F.coalesce((F.col(value) != F.lag(value).over(order)).cast("int"), F.lit(1))
    marked = bars.withColumn("changed", changed).withColumn("run", F.sum("changed").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("asset_id", "market", "run").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count(F.lit(1)).alias("length")).where(F.col("length") >= least).drop("run")


def extreme_moves(bars: DataFrame, limit: float) -> DataFrame:
    """Bars whose return is beyond the limit, told apart by what follows: ``reverted``, ``gap`` before it, or ``move``."""
    order = w.by_asset()
    m = bars.withColumns({"ret": w.change("adj_close"), "days": F.datediff("date", F.lag("date").over(order))})
    m = m.withColumn("next_ret", F.lead("ret").over(order))
    kind = F.when(F.col("days") > 14, "gap").when((F.col("ret") * F.col("next_ret") < 0) & (F.abs((1 + F.col("ret")) * (1 + F.col("next_ret")) - 1) <= limit / 2), "reverted").otherwise("move")
    return m.where(F.abs("ret") > limit).select("asset_id", "market", "date", "ret", kind.alias("kind"))


def eligible(bars: DataFrame, history: int, amount: float, n: int = 20) -> DataFrame:
    """Assets per date with enough history and a trailing median amount."""
    m = bars.withColumns({"seen": F.row_number().over(w.by_asset()), "median_amount": w.middle("amount", n)})
    return m.where((F.col("seen") >= history) & (F.col("median_amount") >= amount)).select("date", "asset_id", "market", "seen", "median_amount")


def basis_repair(bars: DataFrame, ratio: str, assets: int, jump: float = 2.0) -> DataFrame:
    """Corrects price-basis jumps that hit many assets on one date: a running product of corrections per asset."""
    order = w.by_asset()
    r = bars.withColumn("step", w.div(ratio, F.lag(ratio).over(order)))
    hit = F.greatest("step", 1 / F.col("step")) > jump
    mass = r.where(hit).groupBy("date").agg(F.count_distinct("asset_id").alias("n")).where(F.col("n") >= assets).select("date", F.lit(True).alias("mass"))
    fixed = r.join(mass, "date", "left").withColumn("fix", F.when(F.col("mass") & hit, 1 / F.col("step")).otherwise(1.0))
    return fixed.withColumn("correction", F.product("fix").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("step", "mass", "fix")
