"""Scores that join price behaviour with side tables: valuation or money flow."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.windows import div
from .families import KEYS, Family, _plus
from .inputs import inverse, valued_features
from .neutralize import ols_residual


def champion_features(bars: DataFrame) -> DataFrame:
    """Bars that carry the valuation columns; every rolling value needs its twenty rows."""
    p = F.col("adj_close")
    low, high = w.lowest(p, 20), w.highest(p, 20)
    df = w.steps(
        bars,
        {"return_1d": w.change(p), "momentum_20": w.change(p, 20), "range_low_20": -div(p - low, high - low), "pb_inv": inverse("pb"), "pe_inv": inverse("pe_ttm")},
        {"down": F.when(F.col("return_1d").isNotNull(), F.least("return_1d", F.lit(0.0)))},
        {"downside_low_20": -w.std("down", 20)},
        {"amount_rank": w.pct_rank("amount"), "momentum_rank": w.pct_rank("momentum_20"), "turnover_rank": w.pct_rank("turnover_rate")},
    )
    return df.withColumns({"turnover_band": -F.abs(F.col("turnover_rank") - 0.30), "amount_mid": -F.abs(F.col("amount_rank") - 0.60)})


CHAMPION = Family(
    champion_features,
    "amount_rank between 0.30 and 0.90 and momentum_rank between 0.10 and 0.80 and turnover_rank <= 0.80",
    {"rankic_neg1_downside_range_blend": {"pb_inv": 1.0, "pe_inv": 1.0, "turnover_band": 1.0, "amount_mid": 1.0, "downside_low_20": 1.0, "range_low_20": 0.50}},
)


def pressure_features(bars: DataFrame, parts: int | None = None) -> DataFrame:
    """Valued features, and where closes lie within their bars, plain and weighted by the amount."""
    where = w.clip(div(F.col("adj_close") - F.col("low"), F.col("high") - F.col("low")), 0.0, 1.0) - 0.50
    paid = F.log1p(F.when(F.col("amount") > 0, F.col("amount")))
    pressure = (
        {"close_location": where, "amount_trend_20": div("adv5", "adv20") - 1},
        {"close_location_20": w.mean("close_location", 20, 5), "pressure_20": w.mean(F.col("close_location") * paid, 20, 5)},
    )
    return valued_features(bars, pressure, parts)


# fixed values
_SMART = {"pressure_20": 1.0, "close_location_20": 0.50, "amount_trend_20": 0.20}
_WORTH = {"pb_inv": 1.0, "pe_inv": 1.0, "ps_inv": 0.50, "dv_ttm": 0.25}
_LOW_TAIL = {"downside_vol_20": -1.0, "hl_range_20": -0.50, "range_position_20": 0.20}

SMART_MONEY = Family(
    pressure_features,
    "adv20_rank > 0.20 and amount_rank > 0.20 and downside_rank <= 0.95 and range_position_20 >= 0.08 and abs(return_1d) <= 0.35",
    {
        "smart_money_quality_lowvol_20": _plus((0.90, _SMART), (0.70, _WORTH), (0.80, _LOW_TAIL), (0.30, {"turnover_rank": -0.60, "volume_ratio": -0.40})),
        "smart_money_efficiency_lowvol_20": _plus((0.85, _SMART), (0.85, {"return_efficiency_20": 1.0}), (0.75, _LOW_TAIL), (0.35, _WORTH), (0.20, {"mid_liquidity": 1.0})),
        "smart_money_reversal_value_20": _plus((0.75, _SMART), (0.75, _WORTH), (0.60, {"reversal_5": 0.65, "momentum_20": -0.25}), (0.45, _LOW_TAIL)),
    },
    fill=True,
    bucket_size="log_size",
    buckets=6,
    dealt=True,
)

BRIDGE = ("risk_filter_bridge_equal_20", "risk_filter_bridge_agreement_20", "risk_filter_bridge_anti_obv_weighted_20")


def risk_filter_bridge(anti: DataFrame, smart: DataFrame, anti_name: str = "anti_obv_breakout_low_tail_20", smart_name: str = "smart_money_reversal_value_20", parts: int | None = None) -> DataFrame:
    """Two factors, a row each per asset, market and date, joined by their cross-section ranks.

    A rank needs two values, a blend both ranks. parts: partitions of the cross-sections (see windows.deal).
    """
    sides = anti.select(*KEYS, F.col(anti_name).alias("a"), F.lit(None).cast("double").alias("b")).unionByName(smart.select(*KEYS, F.lit(None).cast("double").alias("a"), F.col(smart_name).alias("b")))
    # dealt by cross-section before the two are put together: a join by asset would deal them by asset first
    df = w.deal(sides, parts).groupBy(*KEYS).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    df = df.withColumns({f"r{c}": F.when(F.count(c).over(w.cross()) > 1, w.pct_rank(c)) for c in "ab"})
    a, b = F.col("ra"), F.col("rb")
    both = a.isNotNull() & b.isNotNull()
    values = ((a + b) / 2, F.least(a, b), 0.65 * a + 0.35 * b)
    return df.select(*KEYS, *[F.when(both, v).alias(n) for n, v in zip(BRIDGE, values)])


ENSEMBLE = ("public_anomaly_residual_equal_weight_20", "public_anomaly_residual_agreement_20", "public_anomaly_residual_disagreement_risk_20", "public_anomaly_residual_regime_conditioned_20")


def anomaly_ensemble(bars: DataFrame, parts: int | None = None) -> DataFrame:
    """Ranks of five components (value, stability, reversal, low volatility, capacity), blended where four are present.

    Components are rounded to nine digits first, so that equal ones tie whatever the order of their sums.

    The market's momentum is a sum over its own dates: returns are averaged per market and date, summed over twenty
    dates, and joined back, one row per market and date. parts: partitions of the cross-sections (see windows.deal).
    """
    p = F.col("adj_close")
    log = lambda c: F.log(F.when(F.col(c) > 0, F.col(c)))
    df = w.steps(
        bars,
        {"ret": w.change(p), "ret_20": w.change(p, 20), "amount_20": w.mean("amount", 20)},
        {"down": F.when(F.col("ret").isNotNull(), F.least("ret", F.lit(0.0))), "abs_ret_20": F.abs("ret_20"), "vol_20": w.std("ret", 20), "cheap_pe": -log("pe_ttm"), "cheap_pb": -log("pb"), "log_amount": log("amount_20")},
        {"down_20": w.std("down", 20)},
    )
    markets = df.groupBy("market", "date").agg(F.avg("ret").alias("market_ret"))
    markets = markets.select("market", "date", w.total("market_ret", 20, keys=("market",)).alias("market_momentum"))
    used = ("ret", "ret_20", "amount_20", "cheap_pe", "cheap_pb", "dv_ttm", "down_20", "abs_ret_20", "vol_20", "log_amount", "turnover_rate_f")
    df = w.deal(df.select(*KEYS, *used), parts)
    z = w.zscore
    blends = {
        "value": (z("cheap_pe") + z("cheap_pb") + z("dv_ttm")) / 3,
        "stable": -0.65 * z("down_20") - 0.35 * z("abs_ret_20"),
        "reversal": -z("ret_20"),
        "calm": -z("vol_20"),
        "capacity": z("log_amount") - 0.25 * z("turnover_rate_f"),
    }
    df = df.withColumns({k: F.round(v, 9) for k, v in blends.items()})
    several = {k: F.count(k).over(w.cross()) > 1 for k in (*blends, "amount_20")}
    df = df.withColumns({f"v_{k}": F.when(ok, F.col(k)) for k, ok in several.items()}).select(*KEYS, "ret", *[f"v_{k}" for k in several])
    df = w.pct_ranks(df, {f"r_{k}": F.col(f"v_{k}") for k in several})
    df = df.withColumnRenamed("r_amount_20", "amount_rank").join(F.broadcast(markets), ["market", "date"], "left")
    ranks = [F.col(f"r_{k}") for k in blends]
    present = sum((r.isNotNull().cast("int") for r in ranks), F.lit(0))
    agree = sum((F.coalesce((r > 0.60).cast("int"), F.lit(0)) for r in ranks), F.lit(0))
    valid = (present >= 4) & (F.col("amount_rank") > 0.25) & (F.abs("ret") <= 0.50)
    df = df.withColumns({"valid": valid, "present": present, "equal": w.row_mean_present(*ranks)})
    spread = F.sqrt(sum((F.coalesce((r - F.col("equal")) ** 2, F.lit(0.0)) for r in ranks), F.lit(0.0)) / (F.col("present") - 1))
    values = (F.col("equal"), agree / 5, 1 - spread + 0.05 * F.col("equal"), F.when(F.col("market_momentum") >= -0.02, F.col("equal")))
    return df.select(*KEYS, *[F.when(F.col("valid"), v).alias(n) for n, v in zip(ENSEMBLE, values)])


@dataclass(frozen=True)
class Combo:
    """A flow's z-score: plus or minus an exposure's, its residual on exposures, or alone (``keep``).

    gate: only where that exposure is at most its cross-section median. floor: only where the bar's amount reaches it.
    """

    flow: str
    kind: str
    exposures: tuple[str, ...] = ()
    gate: str | None = None
    floor: bool = False


_LARGE, _THREE = "large_order_net_amount_ratio", ("liquidity_20", "volatility_20", "log_amount_20")
# fixed values
COMBOS = {
    "mf_low_plus_momentum_5": Combo("net_mf_amount_ratio_low", "plus", ("momentum_5",)),
    "mf_low_plus_reversal_5": Combo("net_mf_amount_ratio_low", "plus", ("reversal_5",)),
    "mf_low_minus_volatility_20": Combo("net_mf_amount_ratio_low", "minus", ("volatility_20",)),
    "large_plus_momentum_5": Combo(_LARGE, "plus", ("momentum_5",)),
    "large_plus_risk_momentum_10": Combo(_LARGE, "plus", ("risk_adjusted_momentum_10",)),
    "large_minus_liquidity_20": Combo(_LARGE, "minus", ("liquidity_20",)),
    "large_resid_liquidity_20": Combo(_LARGE, "residual", ("liquidity_20",)),
    "large_resid_liquidity_gate_20": Combo(_LARGE, "residual", ("liquidity_20",), gate="liquidity_20"),
    "large_resid_liq_vol_amt_20": Combo(_LARGE, "residual", _THREE),
    "large_resid_liq_vol_amt_gate_20": Combo(_LARGE, "residual", _THREE, floor=True),
    "large_liquidity_gate_20": Combo(_LARGE, "keep", gate="liquidity_20"),
    "mf_low_minus_volatility_liquidity_gate_20": Combo("net_mf_amount_ratio_low", "minus", ("volatility_20",), gate="liquidity_20"),
    "large_plus_risk_momentum_liquidity_gate_10": Combo(_LARGE, "plus", ("risk_adjusted_momentum_10",), gate="liquidity_10"),
    "extra_plus_momentum_10": Combo("extra_large_order_net_amount_ratio", "plus", ("momentum_10",)),
    "extra_low_plus_reversal_5": Combo("extra_large_order_net_amount_ratio_low", "plus", ("reversal_5",)),
    "small_sell_plus_reversal_5": Combo("small_order_sell_pressure", "plus", ("reversal_5",)),
    "small_sell_low_plus_momentum_5": Combo("small_order_sell_pressure_low", "plus", ("momentum_5",)),
}


def flow_exposures(bars: DataFrame) -> DataFrame:
    p, amount = F.col("adj_close"), F.col("amount")
    return w.steps(
        bars,
        {"ret": w.change(p), "momentum_5": w.change(p, 5), "momentum_10": w.change(p, 10), "log_amount_20": F.log1p(F.when(amount > 0, amount))},
        {"amihud": div(F.abs("ret"), amount), "reversal_5": -F.col("momentum_5"), "volatility_10": w.std("ret", 10), "volatility_20": w.std("ret", 20)},
        {"liquidity_10": w.mean("amihud", 10), "liquidity_20": w.mean("amihud", 20), "risk_adjusted_momentum_10": div("momentum_10", "volatility_10")},
    )


def flow_combinations(bars: DataFrame, flows: DataFrame, names: tuple[str, ...] = tuple(COMBOS), floor: float = 100_000_000.0) -> DataFrame:
    """Money flow with price behaviour, for rows that both tables have.

    The tables are joined first, so z-scores, gates and the sums of the regressions share one exchange by cross-section.
    A z-score is taken over all present values of its own table. Regressions need more rows than exposures and are
    NULL where those depend on one another.
    """
    unknown = sorted(set(names) - set(COMBOS))
    if unknown:
        raise ValueError(f"unknown combinations: {', '.join(unknown)}")
    made = [COMBOS[n] for n in names]
    flow_names = sorted({c.flow for c in made})
    outside = sorted({x for c in made for x in (*c.exposures, c.gate) if x})
    left = flow_exposures(bars).select(*KEYS, *outside, "amount", F.lit(True).alias("priced"))
    right = flows.select(*KEYS, *flow_names, F.lit(True).alias("flowed"))
    df = left.join(right, KEYS, "full").withColumns({f"z_{x}": w.zscore(x) for x in (*flow_names, *outside)})
    df = df.where("priced and flowed")
    fits = {}
    for c in made:
        if c.kind == "residual" and (c.flow, c.exposures) not in fits:
            out = fits[c.flow, c.exposures] = f"fit_{len(fits)}"
            df = ols_residual(df, f"z_{c.flow}", [f"z_{x}" for x in c.exposures], least=len(c.exposures) + 1, out=out)
    middle = {g: F.median(f"z_{g}").over(w.cross()) for g in sorted({c.gate for c in made if c.gate})}
    df = df.withColumns({f"open_{g}": F.col(f"z_{g}") <= m for g, m in middle.items()})

    def value(c: Combo):
        z = F.col(f"z_{c.flow}")
        x = F.col(f"z_{c.exposures[0]}") if c.exposures else None
        v = {"plus": lambda: z + x, "minus": lambda: z - x, "residual": lambda: F.col(fits[c.flow, c.exposures]), "keep": lambda: z}[c.kind]()
        if c.gate:
            v = F.when(F.col(f"open_{c.gate}"), v)
        return F.when(F.col("amount") >= floor, v) if c.floor else v

    return df.select(*KEYS, *[value(COMBOS[n]).alias(n) for n in names])
