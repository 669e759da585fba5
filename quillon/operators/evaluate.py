"""Evaluation of factors against forward returns."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import windows as w
from ..functions.windows import div

GROUP = ["date", "market", "factor_name"]


@F.pandas_udf(T.DoubleType())
def _erfc(x: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in x:
        yield s.map(lambda v: None if pd.isna(v) else math.erfc(v))


def normal_p(t: Column) -> Column:
    """Two-sided p-value of a normal statistic; for aggregated rows only, as Spark SQL has no erfc."""
    return _erfc(F.abs(t) / math.sqrt(2.0))


def merged(factors: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[str]]:
    """Factor and label rows joined, and what identifies an evaluation."""
    shared = [c for c in ("horizon", "execution_lag") if c in labels.columns]
    on = ["date", "asset_id", "market"] + [c for c in shared if c in factors.columns]
    return factors.join(labels, on, "inner").where("factor_value is not null and forward_return is not null"), GROUP + shared


def _corr(a: str, b: str) -> Column:
    return w.corr(F.col(a), F.col(b))


def information_coefficient(factors: DataFrame, labels: DataFrame, p_values: bool = True) -> DataFrame:
    """Pearson and Spearman correlation of factor and return per group, with t statistics and p-values."""
    return correlations(*merged(factors, labels), p_values)


def correlations(rows: DataFrame, keys: list[str], p_values: bool = True) -> DataFrame:
    """information_coefficient() of rows that have both."""
    ranked = rows.withColumns({"fr": w.avg_rank("factor_value", tuple(keys)), "rr": w.avg_rank("forward_return", tuple(keys))})
    out = ranked.groupBy(*keys).agg(_corr("factor_value", "forward_return").alias("ic"), _corr("fr", "rr").alias("rank_ic"), F.count(F.lit(1)).alias("count"))
    for name in ("ic", "rank_ic"):
        r = F.col(name)
        sure = F.abs(r) >= 1 - 1e-12  # one, up to rounding
        t = F.when(F.col("count") >= 3, F.when(sure, F.signum(r) * 1e12).otherwise(r * F.sqrt((F.col("count") - 2) / F.nullif(1 - r * r, F.lit(0.0)))))
        out = out.withColumn(f"{name}_t_stat", t)
        if p_values:
            out = out.withColumn(f"{name}_p_value", normal_p(F.col(f"{name}_t_stat")))
    return out


def quantile_returns(factors: DataFrame, labels: DataFrame, quantiles: int = 5) -> DataFrame:
    return bucket_returns(*merged(factors, labels), quantiles)


def bucket_returns(rows: DataFrame, keys: list[str], quantiles: int = 5) -> DataFrame:
    """quantile_returns() of rows that have both."""
    placed = rows.withColumn("quantile", w.ceil_bucket("factor_value", quantiles, tuple(keys)))
    return placed.groupBy(*keys, "quantile").agg(F.avg("forward_return").alias("mean_forward_return"), F.count(F.lit(1)).alias("count"))


def long_short(groups: DataFrame, quantiles: int = 5) -> DataFrame:
    """Return of the top bucket less that of the bottom one."""
    keys = [c for c in groups.columns if c in (*GROUP, "horizon", "execution_lag")]
    at = lambda q: F.max(F.when(F.col("quantile") == q, F.col("mean_forward_return")))
    both = groups.where(F.col("quantile").isin(1, quantiles)).groupBy(*keys).agg((at(quantiles) - at(1)).alias("long_short_return"))
    return both.where("long_short_return is not null")


def newey_west(series: DataFrame, keys: list[str], value: str, order: str = "date", max_lag: int | None = None, p_values: bool = True) -> DataFrame:
    """Test of a zero mean with Bartlett weights over the automatic number of lags; one row per key.

    A series is one value per date, so its ordered array is bounded by the calendar.
    """
    s = series.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, F.col(value).alias("v")))).alias("a"), F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    auto = F.greatest(F.lit(1), F.floor(4 * F.pow(F.col("n") / 100.0, F.lit(2.0 / 9.0))).cast("int"))
    lags = F.least(F.lit(max_lag) if max_lag is not None else auto, (F.col("n") - 1).cast("int"))
    s = s.withColumns({"max_lag": F.greatest(F.lit(0), lags), "c": F.transform("a", lambda x: x["v"] - F.col("mean"))})
    dot = lambda k: F.aggregate(F.zip_with(F.slice("c", k + 1, F.size("c")), F.slice("c", 1, F.size("c") - k), lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
    gamma = F.aggregate("c", F.lit(0.0), lambda acc, x: acc + x * x)
    tail = F.when(F.col("max_lag") > 0, F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest("max_lag", F.lit(1))), lambda k: 2 * (1 - k / (F.col("max_lag") + 1.0)) * dot(k)), F.lit(0.0), lambda acc, x: acc + x)).otherwise(F.lit(0.0))
    s = s.withColumn("variance", F.when(F.col("n") >= 2, F.greatest(F.lit(0.0), (gamma + tail) / (F.col("n") - 1))))
    s = s.withColumn("standard_error", F.coalesce(F.sqrt(F.col("variance") / F.col("n")), F.lit(0.0)))
    s = s.withColumn("t_stat", F.coalesce(div("mean", "standard_error"), F.lit(0.0)))
    if p_values:
        s = s.withColumn("p_value", F.when(F.col("standard_error") > 0, normal_p(F.col("t_stat"))).otherwise(F.lit(1.0)))
    return s.drop("a", "c", "variance")


def ic_summary(ic: DataFrame, column: str = "rank_ic", p_values: bool = True) -> DataFrame:
    """Mean, ratio to its deviation, share above zero and Newey-West test of each factor's series."""
    keys = [c for c in ("market", "factor_name", "horizon", "execution_lag") if c in ic.columns]
    base = ic.where(F.col(column).isNotNull()).groupBy(*keys).agg(F.stddev_pop(column).alias("sd"), F.avg((F.round(column, 12) > 0).cast("double")).alias("positive_rate"))
    test = newey_west(ic, keys, column, p_values=p_values)
    out = base.join(test, keys).withColumn("icir", div("mean", "sd"))
    return out.select(*keys, F.col("mean").alias("mean_ic"), "icir", "positive_rate", "n", "max_lag", F.col("t_stat").alias("nw_t_stat"), *(["p_value"] if p_values else []))


def top_set_turnover(factors: DataFrame, q: int = 5) -> DataFrame:
    """1 - overlap / larger size of the top bucket on consecutive dates of a market."""
    keys = ("date", "market", "factor_name")
    top = factors.withColumn("bucket", w.edge_bucket("factor_value", q, keys)).where(F.col("bucket") == q - 1).select(*keys, "asset_id")
    dates = top.select(*keys).distinct().withColumn("step", F.row_number().over(Window.partitionBy("market", "factor_name").orderBy("date")))
    held = top.join(dates, list(keys))
    size = held.groupBy("market", "factor_name", "step", "date").agg(F.count(F.lit(1)).alias("size"))
    before = held.select("market", "factor_name", "asset_id", (F.col("step") + 1).alias("step"))
    shared = held.join(before, ["market", "factor_name", "asset_id", "step"]).groupBy("market", "factor_name", "step").agg(F.count(F.lit(1)).alias("shared"))
    prior = size.select("market", "factor_name", (F.col("step") + 1).alias("step"), F.col("size").alias("prior_size"))
    joined = size.join(prior, ["market", "factor_name", "step"]).join(shared, ["market", "factor_name", "step"], "left")
    return joined.select("date", "market", "factor_name", (1 - F.coalesce("shared", F.lit(0)) / F.greatest("size", "prior_size")).alias("turnover"))


def factor_correlation(left: DataFrame, right: DataFrame, parts: int | None = None) -> DataFrame:
    """Mean daily rank correlation of every factor on the left with every one on the right.

    parts: partitions of the ranked cross-sections (see windows.deal).
    """
    r = right.select("date", "asset_id", "market", F.col("factor_name").alias("reference_name"), F.col("factor_value").alias("reference_value"))
    both = left.join(r, ["date", "asset_id", "market"]).where("factor_value is not null and reference_value is not null")
    keys = ("date", "market", "factor_name", "reference_name")
    ranked = w.deal(both, parts, keys).withColumns({"a": w.avg_rank("factor_value", keys), "b": w.avg_rank("reference_value", keys)})
    daily = ranked.groupBy(*keys).agg(_corr("a", "b").alias("c"))
    return daily.where("c is not null").groupBy("factor_name", "reference_name").agg(F.avg("c").alias("mean_correlation"), F.count(F.lit(1)).alias("n_dates"))


def benjamini_hochberg(tests: DataFrame, p: str, keys: list[str], tie: list[str]) -> DataFrame:
    """Step-up adjusted p-values within each key, and Bonferroni ones."""
    part = Window.partitionBy(*keys)
    m = F.count(F.col(p)).over(part)
    ranked = tests.where(F.col(p).isNotNull()).withColumns({"m": m, "rank": F.row_number().over(part.orderBy(p, *tie))})
    raw = ranked.withColumn("raw", F.col(p) * F.col("m") / F.col("rank"))
    up = part.orderBy("rank").rowsBetween(0, Window.unboundedFollowing)
    return raw.withColumns({"bh_p_value": F.least(F.lit(1.0), F.min("raw").over(up)), "bonferroni_p_value": F.least(F.lit(1.0), F.col(p) * F.col("m"))}).drop("raw", "m")
