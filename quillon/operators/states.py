"""Macro states from a released series, what factors earned in each of them, and signals as they stood on a day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import div
from .asof import asof_by_key


def macro_states(releases: DataFrame, flat: float) -> DataFrame:
    """(release_date, rate, change, state) of a released rate: easing, flat or tightening against the release before.

    A missing rate takes the last known one, and says so in ``repaired``; leading ones are left out. Several rows of a day
    are one, the largest.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("release_date")  # releases are some hundreds, whatever the panel
    daily = releases.groupBy("release_date").agg(F.max("rate").alias("released"))
    filled = daily.withColumn("rate", F.last("released", ignorenulls=True).over(order)).where("rate is not null")
    change = filled.withColumn("change", F.col("rate") - F.lag("rate").over(order))
    state = F.when(F.col("change") > flat, "tightening").when(F.col("change") < -flat, "easing").otherwise("flat")
    return change.select("release_date", "rate", F.col("released").isNull().alias("repaired"), "change", F.when(F.col("change").isNotNull(), state).otherwise("unknown").alias("state"))


def state_conditioned_ic(ic: DataFrame, states: DataFrame, keys: list[str], value: str = "rank_ic", lag_days: int = 1) -> DataFrame:
    """(keys, state, n, mean_ic, t_stat, positive_rate): daily correlations by the state known on the date.

    A release counts from ``lag_days`` after its day. A date's correlations are one array that meets the states, so that
    correlations are computed once and not again for their dates; there are as many as dates, keys and factors.
    """
    known = states.groupBy(F.date_add("release_date", lag_days).alias("known_from")).agg(F.max("state").alias("state")).withColumn("__all", F.lit(0))
    days = ic.where(F.col(value).isNotNull()).groupBy("date").agg(F.collect_list(F.struct(*keys, value)).alias("__of_day")).withColumn("__all", F.lit(0))
    hit = asof_by_key(days, known, ["__all"], "date", "known_from", ["state"])
    met = hit.select(F.coalesce("state", F.lit("unknown")).alias("state"), F.inline("__of_day"))
    v = F.col(value)
    out = met.groupBy(*keys, "state").agg(F.count(v).alias("n"), F.avg(v).alias("mean_ic"), F.stddev_samp(v).alias("sd"), F.avg((v > 0).cast("double")).alias("positive_rate"))
    return out.withColumn("t_stat", F.when(F.col("n") > 1, div(F.col("mean_ic") * F.sqrt("n"), F.when(F.col("sd") > 1e-12, F.col("sd"))))).drop("sd")


def signal_snapshot(factors: DataFrame, bars: DataFrame, as_of: str, top: int, cap: float, max_age: int) -> DataFrame:
    """The signals that stood on a day: per market and factor the best assets of its last date, with their latest price.

    Only rows up to the day are seen. Weights are equal, ``cap`` at most; a signal is stale if its date is more than
    ``max_age`` days old, and an asset without a price by the day has none.
    """
    day = F.lit(as_of).cast("date")
    past = factors.where((F.col("date") <= day) & F.col("factor_value").isNotNull())
    last = past.groupBy("market", "factor_name").agg(F.max("date").alias("date"))
    best = Window.partitionBy("market", "factor_name").orderBy(F.desc("factor_value"), "asset_id")
    picked = past.join(last, ["market", "factor_name", "date"]).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    n = F.count(F.lit(1)).over(Window.partitionBy("market", "factor_name"))
    prices = bars.where((F.col("date") <= day) & F.col("adj_close").isNotNull()).groupBy("asset_id").agg(F.max_by("adj_close", "date").alias("price"), F.max("date").alias("price_date"))
    out = picked.withColumn("weight", F.least(1 / n, F.lit(cap))).join(prices, "asset_id", "left")
    return out.select("market", "factor_name", F.col("date").alias("signal_date"), "asset_id", "rank", "factor_value", "weight", "price", "price_date", (F.datediff(day, "date") > max_age).alias("stale"))
