"""Breakdowns of trades and return series, regimes, purged folds, and feature sets of single screens."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import windows as w
from ..functions.windows import div
from .families import KEYS


def contributions(trades: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Sum, count and share of weighted returns by a dimension of traded rows."""
    g = trades.where("reject is null").groupBy(*keys, *by).agg(F.sum("weighted_return").alias("contribution"), F.count(F.lit(1)).alias("trades"))
    return g.withColumn("share", div("contribution", F.sum("contribution").over(Window.partitionBy(*keys))))


def trade_quantiles(trades: DataFrame, keys: list[str], column: str, at: tuple[float, ...] = (0.01, 0.5, 0.99)) -> DataFrame:
    """Exact interpolated quantiles and extremes of traded rows."""
    done = trades.where("reject is null")
    out = done.groupBy(*keys).agg(F.min(column).alias("lowest"), F.max(column).alias("highest"), F.count(F.lit(1)).alias("trades"))
    return out.join(w.exact_quantiles(done, keys, {f"q{round(q * 100):02d}": (F.col(column), q) for q in at}), keys)


def capacity_stress(trades: DataFrame, keys: list[str], multipliers: tuple[float, ...], limit: float) -> DataFrame:
    """Share of trades whose participation passes the limit when the portfolio is so many times larger."""
    grid = trades.where("reject is null and participation_rate is not null").withColumn("multiplier", F.explode(F.array(*[F.lit(float(m)) for m in multipliers])))
    breach = (F.col("participation_rate") * F.col("multiplier") > limit).cast("double")
    return grid.groupBy(*keys, "multiplier").agg(F.avg(breach).alias("breach_rate"), F.max(F.col("participation_rate") * F.col("multiplier")).alias("top_participation"), F.count(F.lit(1)).alias("trades"))


def return_blocks(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Compounded return of each year, and of everything without that year."""
    logs = curve.withColumn("year", F.year("date")).groupBy(*keys, "year").agg(F.product(1 + F.col("period_return")).alias("grown"), F.count(F.lit(1)).alias("periods"))
    whole = F.product("grown").over(Window.partitionBy(*keys))
    return logs.select(*keys, "year", "periods", (F.col("grown") - 1).alias("year_return"), (div(whole, "grown") - 1).alias("return_without_year"))


def regimes(curve: DataFrame, keys: list[str], n: int = 20, edge: float = 0.02) -> DataFrame:
    """bull above +edge of momentum over n dates, bear below -edge, sideways between."""
    m = div("equity", F.lag("equity", n).over(Window.partitionBy(*keys).orderBy("date"))) - 1
    label = F.when(F.col("momentum") > edge, "bull").when(F.col("momentum") < -edge, "bear").otherwise("sideways")
    return curve.withColumn("momentum", m).where("momentum is not null").withColumn("regime", label)


def net_of_cost(spread: DataFrame, turnover: DataFrame, keys: list[str], costs: tuple[float, ...]) -> DataFrame:
    """Spread returns less cost * turnover for each cost; all of it is traded on a key's first date."""
    joined = spread.join(turnover.select(*keys, "date", "turnover"), [*keys, "date"], "left")
    grid = joined.withColumn("cost", F.explode(F.array(*[F.lit(float(c)) for c in costs])))
    return grid.withColumn("net_return", F.col("long_short_return") - F.col("cost") * F.coalesce("turnover", F.lit(1.0)))


def neutral_ic(rows: DataFrame, keys: tuple[str, ...], industry: str = "industry", least: int = 3, industries: int = 2) -> DataFrame:
    """Pooled correlation of ranks taken within industries that have enough assets."""
    inner = (*keys, industry)
    whole = rows.where(f"factor_value is not null and forward_return is not null and {industry} is not null")
    big = whole.withColumn("members", F.count(F.lit(1)).over(w.cross(inner))).where(F.col("members") >= least)
    ranked = big.withColumns({"fr": w.pct_rank("factor_value", inner), "rr": w.pct_rank("forward_return", inner)})
    out = ranked.groupBy(*keys).agg(w.corr(F.col("fr"), F.col("rr")).alias("neutral_rank_ic"), F.count(F.lit(1)).alias("assets"), F.count_distinct(industry).alias("industries"))
    return out.where(F.col("industries") >= industries)


def purged_folds(curves: DataFrame, keys: list[str], groups: int, chosen: int, gap: int) -> DataFrame:
    """Combinatorial purged folds: (keys, split, date, role).

    Dates are cut into ``groups`` runs; every combination of two (``chosen``) runs is a test set; dates within ``gap``
    positions of a test run are left out of training.
    """
    if chosen != 2:
        raise ValueError("combinations of two test groups are built")
    n = curves.select(*keys, "date").distinct().withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("date")))
    n = n.withColumn("g", F.floor((F.col("i") - 1) * groups / F.count(F.lit(1)).over(Window.partitionBy(*keys))).cast("int"))
    # a key's runs are at most ``groups``, gathered beside its dates: the curves are not computed again for them
    of_run = Window.partitionBy(*keys, "g")
    runs = n.withColumn("run", F.struct("g", F.min("i").over(of_run).alias("a"), F.max("i").over(of_run).alias("z")))
    runs = runs.withColumn("runs", F.collect_set("run").over(Window.partitionBy(*keys)))
    left = runs.select(*keys, "date", "i", "g", "runs", F.inline("runs").alias("g1", "a1", "z1"))
    every = left.select(*keys, "date", "i", "g", "g1", "a1", "z1", F.inline("runs").alias("g2", "a2", "z2")).where("g1 < g2").withColumn("split", F.col("g1") * groups + F.col("g2"))
    near = lambda a, z: F.col("i").between(F.col(a) - gap, F.col(z) + gap)
    role = F.when((F.col("g") == F.col("g1")) | (F.col("g") == F.col("g2")), "test").when(near("a1", "z1") | near("a2", "z2"), "purged").otherwise("train")
    return every.select(*keys, "split", "date", role.alias("role"))


@F.pandas_udf(T.DoubleType())
def _psr(sharpe: pd.Series, n: pd.Series, skew: pd.Series, kurt: pd.Series, bar: pd.Series) -> pd.Series:
    def one(s, k, g3, g4, b):
        var = 1 - g3 * s + (g4 - 1) / 4 * s * s
        return NormalDist().cdf((s - b) * math.sqrt(k - 1) / math.sqrt(var)) if k > 1 and var > 0 and not math.isnan(s) else None

    return pd.Series([one(*x) for x in zip(sharpe, n, skew, kurt, bar)])


def probabilistic_sharpe(curve: DataFrame, keys: list[str], benchmark: float = 0.0) -> DataFrame:
    """Chance that a series' Sharpe ratio per period beats the benchmark's, given its skew and kurtosis."""
    r = F.col("period_return")
    s = curve.groupBy(*keys).agg(div(F.avg(r), F.stddev_samp(r)).alias("sharpe"), F.count(r).alias("n"), F.skewness(r).alias("skew"), (F.kurtosis(r) + 3).alias("kurtosis"))
    return s.withColumn("psr", _psr("sharpe", "n", "skew", "kurtosis", F.lit(float(benchmark))))


def decay_mean(c: str, n: int) -> Column:
    """Mean of the last n rows with weights n, n - 1, ..., 1; the weights of missing rows are left out."""
    lags = [(n - k, F.col(c) if k == 0 else w.lag(c, k)) for k in range(n)]
    total = sum((F.coalesce(x * k, F.lit(0.0)) for k, x in lags[1:]), F.coalesce(lags[0][1] * lags[0][0], F.lit(0.0)))
    weight = sum((F.when(x.isNotNull(), k).otherwise(0) for k, x in lags[1:]), F.when(lags[0][1].isNotNull(), lags[0][0]).otherwise(0))
    return div(total, weight.cast("double"))


SCREEN = ("close_position", "gap_fade", "decayed_return_10", "high_52week", "breakout_52week", "overnight_20", "intraday_20", "max_return_20", "upper_shadow_20")


def screen_features(bars: DataFrame) -> DataFrame:
    """Features of single screens: place in the bar, gaps, decayed returns, distance to the year's high, parts of the day."""
    p, o = F.col("adj_close"), F.col("open")
    df = w.steps(
        bars,
        {"ret": w.change(p), "overnight": div(o, w.lag(p)) - 1, "intraday": div(p, o) - 1, "prior_high": w.highest("high", 52, shift=1), "year_high": w.highest("high", 52), "shadow": div(F.col("high") - F.greatest(p, o), F.col("high"))},
        {"close_position": div(p - F.col("low"), F.col("high") - F.col("low")), "gap_fade": -F.col("overnight"), "decayed_return_10": decay_mean("ret", 10), "high_52week": div(p, "year_high"), "breakout_52week": div(p, "prior_high") - 1, "overnight_20": w.mean("overnight", 20), "intraday_20": w.mean("intraday", 20), "max_return_20": w.highest("ret", 20), "upper_shadow_20": w.mean("shadow", 20)},
    )
    return df.select(*KEYS, *SCREEN)
