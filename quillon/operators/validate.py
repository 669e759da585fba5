"""Overlays, folds and robustness of return series, keyed by series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.windows import div


def vol_target(curve: DataFrame, keys: list[str], target: float, n: int = 20, cap: float = 1.0) -> DataFrame:
    """Exposure = target / trailing deviation of earlier periods, capped; full exposure until it is known."""
    past = Window.partitionBy(*keys).orderBy("date").rowsBetween(-n, -1)
    sd = F.when(F.count("period_return").over(past) >= n, F.stddev_samp("period_return").over(past))
    exposure = F.coalesce(F.least(F.lit(cap), div(F.lit(target), sd)), F.lit(1.0))
    return curve.withColumn("exposure", exposure).withColumn("scaled_return", F.col("period_return") * F.col("exposure"))


def market_state_cap(curve: DataFrame, benchmark: DataFrame, lookback: int, weak: float) -> DataFrame:
    """Exposure ``weak`` in periods after which the market's momentum was negative, one period late."""
    order = Window.partitionBy("market").orderBy("date")
    state = benchmark.withColumn("momentum", div("equity", F.lag("equity", lookback).over(order)) - 1)
    state = state.withColumn("cap", F.when(F.lag("momentum").over(order) < 0, weak).otherwise(1.0)).select("market", "date", "cap")
    return curve.join(state, ["market", "date"], "left").withColumn("cap", F.coalesce("cap", F.lit(1.0))).withColumn("scaled_return", F.col("period_return") * F.col("cap"))


def rolling_folds(dates: DataFrame, train: int, test: int, keys: list[str]) -> DataFrame:
    """(fold, train_start, train_end, test_start, test_end) by position of the date within the key.

    A key's distinct dates are one array, as long as the calendar.
    """
    days = dates.groupBy(*keys).agg(F.sort_array(F.collect_set("date")).alias("days")).where(F.size("days") >= train + test)
    folds = days.select(*keys, "days", F.explode(F.sequence(F.lit(0), F.floor((F.size("days") - train - test) / test).cast("int"))).alias("fold"))
    first = F.col("fold") * test
    at = {"train_start": first + 1, "train_end": first + train, "test_start": first + train + 1, "test_end": first + train + test}
    return folds.select(*keys, "fold", *[F.element_at("days", v.cast("int")).alias(k) for k, v in at.items()])


def walk_forward_choice(curves: DataFrame, folds: DataFrame, keys: list[str], case: str) -> DataFrame:
    """For every fold the case with the best train score (mean over deviation), and what it earned in the test.

    One join of curves and folds gives both parts, by aggregates over the dates of each.
    """
    met = curves.join(folds, keys).where(F.col("date").between(F.col("train_start"), F.col("test_end")))
    r = F.col("period_return")
    train, test = (F.when(F.col("date").between(F.col(f"{x}_start"), F.col(f"{x}_end")), r) for x in ("train", "test"))
    each = met.groupBy(*keys, "fold", case).agg(F.round(div(F.avg(train), F.stddev_pop(train)), 10).alias("train_score"), (F.product(1 + test) - 1).alias("test_return"), F.nullif(F.count(test), F.lit(0)).alias("test_periods"))
    best = Window.partitionBy(*keys, "fold").orderBy(F.desc("train_score"), case)
    return each.where("train_score is not null").withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")


def block_bootstrap(paired: DataFrame, keys: list[str], a: str, b: str, block: int, draws: int, seed: int) -> DataFrame:
    """Mean difference of two return series over redrawn blocks of dates, per draw. Blocks are chosen by hash."""
    order = Window.partitionBy(*keys).orderBy("date")
    blocks = paired.withColumn("block", F.floor((F.row_number().over(order) - 1) / block)).groupBy(*keys, "block").agg(F.sum(F.col(a) - F.col(b)).alias("d"), F.count(F.lit(1)).alias("n"))
    size = blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("blocks"))
    plan = size.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("pick", F.explode(F.sequence(F.lit(1), F.col("blocks").cast("int"))))
    digest = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(seed), *keys, "draw", "pick")), 1, 8), 16, 10).cast("long")
    plan = plan.withColumn("block", F.pmod(digest, F.col("blocks")))
    return plan.join(blocks, [*keys, "block"]).groupBy(*keys, "draw").agg((F.sum("d") / F.sum("n")).alias("mean_difference"))


def pair_correlations(curves: DataFrame, keys: list[str], case: str) -> DataFrame:
    """Correlation of every pair of return series of a key over their shared dates."""
    b = curves.select(*keys, "date", F.col(case).alias("other"), F.col("period_return").alias("other_return"))
    both = curves.select(*keys, "date", case, "period_return").join(b, [*keys, "date"]).where(F.col(case) < F.col("other"))
    return both.groupBy(*keys, case, "other").agg(w.corr(F.col("period_return"), F.col("other_return")).alias("correlation"), F.count(F.lit(1)).alias("n"))


def jaccard(selections: DataFrame, keys: list[str], case: str) -> DataFrame:
    """Shared over joint selections of every pair of cases."""
    s = selections.select(*keys, case).distinct()
    size = s.groupBy(case).agg(F.count(F.lit(1)).alias("size"))
    other = s.withColumnRenamed(case, "other")
    shared = s.join(other, keys).where(F.col(case) < F.col("other")).groupBy(case, "other").agg(F.count(F.lit(1)).alias("shared"))
    sizes = shared.join(size, case).join(size.select(F.col(case).alias("other"), F.col("size").alias("other_size")), "other")
    return sizes.select(case, "other", "shared", (F.col("shared") / (F.col("size") + F.col("other_size") - F.col("shared"))).alias("jaccard"))
