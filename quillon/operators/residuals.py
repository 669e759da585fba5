"""Residual composites, listing age and boards, and residual risk against the cross-section's own market."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import windows as w
from ..functions.windows import div
from . import inputs
from .families import KEYS, Family, _plus
from .neutralize import ols_residuals

_LOW_TAIL = {"downside_vol_20": -1.0, "hl_range_20": -0.50, "range_position_20": 0.25}
_CALM_CROWD = {"turnover_rank": -1.0, "volume_ratio": -0.50, "amount_trend_20": -0.30}
_SIZE = ("log_size", "log_adv20", "momentum_20")

#: name -> (weights of z-scores, exposures that are regressed out)
RESIDUAL_COMPOSITES = {
    "resid_value_quality_low_vol_20": (_plus((1.0, inputs._VALUE), (0.30, {"dv_ttm": 1.0}), (0.70, _LOW_TAIL), (0.20, {"mid_liquidity": 1.0})), _SIZE),
    "resid_value_low_turnover_quality_20": (_plus((1.0, inputs._VALUE), (0.60, _CALM_CROWD), (0.40, _LOW_TAIL)), _SIZE),
    "resid_value_reversal_low_tail_20": (_plus((0.80, inputs._VALUE), (0.60, {"reversal_5": 0.70, "momentum_20": -0.30}), (0.50, _LOW_TAIL)), ("log_size", "log_adv20", "turnover_rank")),
}


def residual_composites(valued_bars: DataFrame, parts: int | None = None) -> DataFrame:
    """Composite scores of tradeable rows, standardised, less what standardised exposures explain of them.

    All composites are columns of one row and share the windows by cross-section. parts: partitions of the cross-sections
    (see windows.deal).
    """
    features = lambda b: inputs.valued_features(b, parts=parts).withColumns({"log_adv20": inputs.log("adv20"), "amount_trend_20": div("adv5", "adv20") - 1})
    gate = "adv20_rank > 0.20 and amount_rank > 0.20 and downside_rank <= 0.85 and range_position_20 >= 0.10 and abs(return_1d) <= 0.35"
    fill = frozenset({f for t, _ in RESIDUAL_COMPOSITES.values() for f in t} - {"dv_ttm"})
    carry = tuple(sorted({x for _, exposures in RESIDUAL_COMPOSITES.values() for x in exposures}))
    df = Family(features, gate, {n: t for n, (t, _) in RESIDUAL_COMPOSITES.items()}, fill=fill, carry=carry).compute(valued_bars)
    held, scaled, cases = {}, {}, {}
    for i, (n, (_, xs)) in enumerate(RESIDUAL_COMPOSITES.items()):
        whole = F.col(n).isNotNull()
        for x in xs:
            whole = whole & F.col(x).isNotNull()
        held |= {f"s{i}": F.when(whole, F.col(n))} | {f"x{i}_{j}": F.when(whole, F.col(x)) for j, x in enumerate(xs)}
        scaled |= {f"y{i}": w.zscore(f"s{i}")} | {f"e{i}_{j}": F.when(F.col(f"s{i}").isNotNull(), F.coalesce(w.zscore(f"x{i}_{j}"), F.lit(0.0))) for j in range(len(xs))}
        cases[f"left{i}"] = (f"y{i}", [f"e{i}_{j}" for j in range(len(xs))])
    df = w.steps(df.select(*KEYS, *carry, *RESIDUAL_COMPOSITES), held, scaled)
    df = ols_residuals(df, cases, w.CROSS, {o: len(xs) + 3 for o, (_, xs) in cases.items()}, on_singular="min_norm")
    return df.select(*KEYS, *[F.when(F.stddev_pop(f"left{i}").over(w.cross()) > 1e-12, F.col(f"left{i}")).alias(n) for i, n in enumerate(RESIDUAL_COMPOSITES)])


def board(symbol: Column, segment: Column, exchange: Column) -> Column:
    """star, gem, bse or main, by the fixed prefixes, suffixes and segment names of the exchanges."""
    s = F.upper(symbol)
    bse = (F.upper(exchange) == "XBEI") | s.endswith(".BJ") | segment.contains("北交")
    star = s.startswith("688") | s.startswith("689") | segment.contains("科创")
    gem = s.startswith("300") | s.startswith("301") | segment.contains("创业")
    return F.when(F.coalesce(bse, F.lit(False)), "bse").when(F.coalesce(star, F.lit(False)), "star").when(F.coalesce(gem, F.lit(False)), "gem").otherwise("main")


LISTING_AGE = ("listing_age_log_seasoned_252", "listing_age_young_overhang_avoidance_252", "listing_age_mid_seasoning_252_1000", "fresh_listing_opening_risk_avoidance_120", "board_permission_mainboard_preference", "growth_board_permission_risk_avoidance", "listing_age_board_compound_risk_avoidance")


def listing_age(bars: DataFrame, basic: DataFrame) -> DataFrame:
    """Scores of calendar age since listing and of the board's access rules. basic: asset_id, symbol, segment, exchange,
    list_date, delist_date; one row per asset."""
    df = bars.select(*KEYS).join(basic, "asset_id", "left").withColumns({"board": board(F.col("symbol"), F.col("segment"), F.col("exchange")), "days": F.datediff("date", "list_date").cast("double")})
    valid = (F.col("days") >= 0) & (F.col("delist_date").isNull() | (F.col("date") <= F.col("delist_date")))
    age = F.when(valid, F.col("days"))
    width = F.log1p(F.lit(1000.0)) - F.log1p(F.lit(252.0))
    young = lambda n: F.when(valid, w.clip((n - F.col("days")), 0.0, n) / n)
    risk = F.when(valid, F.when(F.col("board") == "bse", 1.0).when(F.col("board").isin("star", "gem"), 0.75).otherwise(0.0))
    df = df.withColumns({"log_age": F.log1p(age), "young": young(252.0), "fresh": young(120.0), "risk": risk})
    df = df.withColumns({"mid": w.clip(1 - F.abs(F.col("log_age") - F.log1p(F.lit(650.0))) / width, -1.0, 1.0), "main": (F.col("board") == "main").cast("double") - F.col("risk")})
    z = {n: w.zscore(n) for n in ("log_age", "young", "mid", "fresh", "main", "risk")}
    values = [z["log_age"], -z["young"], z["mid"], -z["fresh"], z["main"], -z["risk"], z["log_age"] - 0.50 * z["risk"]]
    return df.select(*KEYS, *[v.alias(n) for n, v in zip(LISTING_AGE, values)])


RESIDUAL_RISK = ("etf_idio_vol_low_60", "etf_downside_beta_low_120", "etf_positive_residual_skew_60")


def residual_risk(bars: DataFrame, least_assets: int = 30, n: int = 120, least: int = 80, down_least: int = 24, m: int = 60, m_least: int = 40, parts: int | None = None) -> DataFrame:
    """Volatility and skew of residuals from the beta known one bar before, and beta on falling markets.

    The market's return goes through the cross-sections and back to the assets; the long frames of an asset's returns are
    then taken with numpy, an asset at a time, as a window would visit every frame row by row for every statistic.
    parts: partitions of the cross-sections and of the assets (see windows.deal).
    """
    r = bars.select(*KEYS, w.change("adj_close").alias("r"))
    k = w.deal(r, parts).withColumn("k", F.when(F.count("r").over(w.cross()) >= least_assets, F.median("r").over(w.cross())))
    schema = T.StructType([*r.select(*KEYS).schema.fields, *[T.StructField(c, T.DoubleType()) for c in RESIDUAL_RISK]])
    return w.deal(k, parts, ("asset_id",)).groupBy("asset_id").applyInPandas(_asset_risk(n, least, down_least, m, m_least), schema)


def _asset_risk(n: int, least: int, down_least: int, m: int, m_least: int):
    def frames(x: np.ndarray, size: int) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(size - 1, np.nan), x]), size)

    def centred(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Present values, their mean, and distances from it (0 where missing) of every frame."""
        count = (~np.isnan(x)).sum(1)
        mean = np.where(np.isnan(x), 0.0, x).sum(1) / np.maximum(count, 1)
        return count, mean, np.where(np.isnan(x), 0.0, x - mean[:, None])

    def beta(a: np.ndarray, b: np.ndarray, low: int) -> np.ndarray:
        """Slope of a on b, which are missing together, in frames where both vary."""
        a = frames(a, n)
        count, _, x = centred(frames(b, n))
        some = ~np.isnan(a)
        moves = np.where(some, a, np.inf).min(1) < np.where(some, a, -np.inf).max(1)
        var, cov = (x * x).sum(1) / np.maximum(count - 1, 1), (x * centred(a)[2]).sum(1) / np.maximum(count - 1, 1)
        good = (count >= max(low, 2)) & moves & (var > 1e-12)
        return np.where(good, cov / np.where(good, var, 1.0), np.nan)

    def mean(x: np.ndarray) -> np.ndarray:
        count, mid, _ = centred(frames(x, n))
        return np.where(count >= max(least, 1), mid, np.nan)

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date", ignore_index=True, na_position="first")
        r, k = pdf["r"].to_numpy(float), pdf["k"].to_numpy(float)
        both = ~np.isnan(r) & ~np.isnan(k)
        down = both & (k < 0)
        pair = lambda where: (np.where(where, r, np.nan), np.where(where, k, np.nan))
        slope = beta(*pair(both), least)
        before = lambda x: np.concatenate([[np.nan], x[:-1]])
        residual = r - before(mean(r) - slope * mean(k)) - before(slope) * k
        count, _, x = centred(frames(residual, m))
        size = np.maximum(count, 1)
        second, third = (x**2).sum(1) / size, (x**3).sum(1) / size
        enough = count >= max(m_least, 1)
        vary = enough & (count > 2) & (second > 0)
        skew = third / np.where(vary, second, 1.0) ** 1.5 * np.sqrt(size * np.maximum(count - 1, 0)) / np.maximum(count - 2, 1)
        made = (np.where(enough, -np.sqrt(second), np.nan), -beta(*pair(down), down_least), np.where(vary, skew, np.nan))
        # pandas has no NULL of its own among doubles
        return pdf[KEYS].assign(**{c: pd.Series(v).astype("Float64") for c, v in zip(RESIDUAL_RISK, made)})

    return of
