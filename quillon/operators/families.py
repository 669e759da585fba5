"""Named factor families.

A family is three things: features of the bars, a gate that says which rows may carry a score, and a table of scores.
A score is a weighted sum of cross-section z-scores of features; the weights are fixed values. A family's features are
built once for all its scores, and scores that are not asked for are never planned.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.windows import div

KEYS = ["asset_id", "market", "date"]


@dataclass(frozen=True)
class Family:
    """features: adds columns to the bars. gate: the SQL condition of a score. scores: name -> {feature: weight}.

    ``fill``: whether a missing z-score counts as 0, for all features or for some. ``bucket_size``: scores become fractional
    ranks within at most ``buckets`` buckets of that column. ``extra``: further conditions of single scores.
    ``carry``: features to give out as well. ``averages``: names that are the mean of the present ones among others.
    ``dealt``: whether features() takes the number of partitions of the cross-sections (see windows.deal) and deals them.
    """

    features: Callable[[DataFrame], DataFrame]
    gate: str
    scores: dict[str, dict[str, float]]
    fill: bool | frozenset[str] = False
    bucket_size: str | None = None
    buckets: int = 5
    extra: dict[str, str] | None = None
    averages: dict[str, tuple[str, ...]] | None = None
    cross: tuple[str, ...] = w.CROSS
    carry: tuple[str, ...] = ()
    dealt: bool = False

    @property
    def names(self) -> tuple[str, ...]:
        return (*self.scores, *(self.averages or {}))

    def compute(self, bars: DataFrame, names: tuple[str, ...] | None = None, parts: int | None = None) -> DataFrame:
        unknown = sorted(set(names or ()) - set(self.names))
        if unknown:
            raise ValueError(f"unknown factors: {', '.join(unknown)}")
        wanted = list(names or self.names)
        base = [n for n in self.scores if n in wanted or any(n in parts for a, parts in (self.averages or {}).items() if a in wanted)]
        used = sorted({f for n in base for f in self.scores[n]})
        df = self.features(bars, parts=parts) if self.dealt else self.features(bars)
        df = df.withColumns({f"z_{f}": w.zscore(f, self.cross) for f in used})
        filled = lambda f: f in self.fill if isinstance(self.fill, frozenset) else self.fill
        z = lambda f: F.coalesce(f"z_{f}", F.lit(0.0)) if filled(f) else F.col(f"z_{f}")
        score = {}
        for n in base:
            terms = [weight * z(f) for f, weight in self.scores[n].items()]
            allowed = f"({self.gate})" + (f" and ({self.extra[n]})" if self.extra and n in self.extra else "")
            score[n] = F.when(F.expr(allowed), sum(terms[1:], terms[0]))
        df = df.withColumns(score)
        if self.bucket_size:
            df = self._in_buckets(df.select(*KEYS, *self.carry, self.bucket_size, *base), base)
        means = {a: w.row_mean_present(*parts) for a, parts in (self.averages or {}).items() if a in wanted}
        return (df.withColumns(means) if means else df).select(*KEYS, *self.carry, *wanted)

    def _in_buckets(self, df: DataFrame, base: list[str]) -> DataFrame:
        """Scores as fractional ranks within buckets; those present on the same rows share their buckets."""
        whole = {n: F.col(n).isNotNull() & F.col(self.bucket_size).isNotNull() for n in base}
        # with the gate alone, and no missing z-scores, all scores are missing together
        together = self.fill is True and not self.extra
        bucket = {n: f"b_{base[0] if together else n}" for n in base}
        df = df.withColumns({b: w.edge_bucket(F.when(whole[n], F.col(self.bucket_size)), self.buckets, self.cross, at_most=True) for n, b in reversed(bucket.items())})
        if not self.dealt:
            return df.withColumns({n: w.pct_rank(F.when(F.col(b).isNotNull(), F.col(n)), (*self.cross, b)) for n, b in bucket.items()})
        rows = df.select(*KEYS, *self.carry, *[F.col(n).alias(f"v_{n}") for n in base], *dict.fromkeys(bucket.values()))
        return w.pct_ranks(rows, {n: (F.when(F.col(b).isNotNull(), F.col(f"v_{n}")), F.col(b)) for n, b in bucket.items()}, self.cross)


def rsi(n: int = 14) -> dict[str, Column]:
    """Stages of the relative strength over simple means; 100, 0 and 50 where only gains, losses or neither occur."""
    up, down = F.col("avg_gain"), F.col("avg_loss")
    value = F.when((down == 0) & (up > 0), 100.0).when((up == 0) & (down > 0), 0.0).when((up == 0) & (down == 0), 50.0).otherwise(100 - 100 / (1 + div(up, down)))
    return {"rsi": F.when(up.isNotNull() & down.isNotNull(), value)}


def oscillators(bars: DataFrame) -> DataFrame:
    """rsi_reversal_14, bollinger_reversal_20, donchian_position_20."""
    p = F.col("adj_close")
    move = p - w.lag(p)
    return w.steps(
        bars,
        {"move": move, "upper": w.highest("high", 20), "lower": w.lowest("low", 20), "center": w.mean(p, 20), "width": w.std(p, 20)},
        {"gain": F.when(F.col("move").isNotNull(), F.greatest("move", F.lit(0.0))), "loss": F.when(F.col("move").isNotNull(), -F.least("move", F.lit(0.0)))},
        {"avg_gain": w.mean("gain", 14), "avg_loss": w.mean("loss", 14)},
        rsi(),
        {"rsi_reversal_14": 100 - F.col("rsi"), "bollinger_reversal_20": -div(p - F.col("center"), "width"), "donchian_position_20": w.clip(div(p - F.col("lower"), F.col("upper") - F.col("lower")), 0.0, 1.0)},
    )


def macd_histogram(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Keys and macd_histogram_12_26_9. Exponential means are recursive: an asset's history is one array, folded in order."""
    past = bars.groupBy("asset_id", "market").agg(F.sort_array(F.collect_list(F.struct("date", "adj_close"))).alias("rows"))
    line = past.withColumn("line", F.zip_with(w.exponential(F.col("rows.adj_close"), fast, fast), w.exponential(F.col("rows.adj_close"), slow, slow), lambda a, b: a - b))
    late = line.withColumn("histogram", F.zip_with("line", w.exponential(F.col("line"), signal, signal), lambda a, b: a - b))
    each = late.select("asset_id", "market", F.inline(F.arrays_zip(F.col("rows.date").alias("date"), F.col("histogram").alias("macd_histogram_12_26_9"))))
    return each.select(*KEYS, "macd_histogram_12_26_9")


def public_technical(bars: DataFrame) -> DataFrame:
    return oscillators(bars).select(*KEYS, "rsi_reversal_14", "bollinger_reversal_20", "donchian_position_20").join(macd_histogram(bars), KEYS, "left")


def _flow(df: DataFrame) -> DataFrame:
    """What the liquidity and tail gates look at, over full windows."""
    p = F.col("adj_close")
    df = w.steps(
        df,
        {"return_1d": w.change(p), "adv20": w.mean("amount", 20), "hl": div("high", "low") - 1, "range_position_20": div(p - w.lowest("low", 20), w.highest("high", 20) - w.lowest("low", 20))},
        {"down": F.when(F.col("return_1d").isNotNull(), F.least("return_1d", F.lit(0.0))), "log_adv20": F.log(F.when(F.col("adv20") > 0, F.col("adv20")))},
        {"downside_vol_20": w.std("down", 20), "hl_range_20": w.mean("hl", 20)},
    )
    return df.withColumns({"adv20_rank": w.pct_rank("adv20"), "downside_rank": w.pct_rank("downside_vol_20"), "hl_rank": w.pct_rank("hl_range_20")})


TECHNICAL_LIQUIDITY = Family(
    lambda bars: _flow(oscillators(bars)),
    "adv20_rank >= 0.60 and abs(return_1d) <= 0.50",
    {
        "rsi_reversal_liquid_14_20": {"rsi_reversal_14": 0.75, "log_adv20": 0.25},
        "bollinger_reversal_liquid_20": {"bollinger_reversal_20": 0.75, "log_adv20": 0.25},
    },
)

TECHNICAL_TAIL_GUARD = Family(
    lambda bars: _flow(oscillators(bars)),
    "adv20_rank >= 0.50 and downside_rank <= 0.75 and hl_rank <= 0.75 and range_position_20 >= 0.15 and abs(return_1d) <= 0.50",
    {
        "rsi_reversal_liquid_low_tail_14_20": {"rsi_reversal_14": 0.70, "log_adv20": 0.20, "downside_vol_20": -0.10},
        "bollinger_reversal_liquid_low_tail_20": {"bollinger_reversal_20": 0.70, "log_adv20": 0.20, "downside_vol_20": -0.10},
    },
)


def true_range() -> Column:
    before = w.lag("adj_close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def trend_volume_features(bars: DataFrame) -> DataFrame:
    p, amount, r = F.col("adj_close"), F.col("amount"), F.col("return_1d")
    df = w.steps(
        _flow(bars),
        {"tr": true_range(), "signed": F.signum(F.coalesce(r, F.lit(0.0))) * amount, "flow_in": F.when(r > 0, amount).otherwise(0.0), "flow_out": F.when(r < 0, amount).otherwise(0.0)},
        {"atr": w.mean("tr", 10), "floor_mid": (w.highest("high", 10) + w.lowest("low", 10)) / 2, "obv": F.sum("signed").over(w.by_asset().rowsBetween(Window.unboundedPreceding, 0)), "paid_in": w.total("flow_in", 20), "paid_out": w.total("flow_out", 20)},
        {"floor": F.col("floor_mid") - 3 * F.col("atr")},
        {
            "momentum_20": w.change(p, 20),
            "amount_stability_20": div(w.lowest("amount", 20), "adv20"),
            "amount_trend_20": div(w.mean("amount", 5), "adv20") - 1,
            "smart_money_pressure_20": div(F.col("paid_in") - F.col("paid_out"), F.col("paid_in") + F.col("paid_out")),
            "obv_slope_20": div(F.col("obv") - w.lag("obv", 20), w.total("amount", 20)),
            "supertrend_distance": div(p - F.col("floor"), "atr"),
            "supertrend_on": (p > F.col("floor")) & (p > w.mean(p, 20)),
        },
    )
    return df


_TREND_GATE = "adv20_rank >= 0.50 and downside_rank <= 0.75 and (hl_rank <= 0.85 or hl_range_20 <= 0.08) and abs(return_1d) <= 0.50"
_STRICT = "adv20_rank >= 0.80 and downside_rank <= 0.60 and (hl_rank <= 0.70 or hl_range_20 <= 0.05) and amount_stability_20 >= 0.25 and abs(return_1d) <= 0.20"
_SUPER = {"supertrend_distance": 0.40, "smart_money_pressure_20": 0.30, "amount_trend_20": 0.20, "log_adv20": 0.10}
_SMART = {"smart_money_pressure_20": 0.45, "amount_trend_20": 0.25, "momentum_20": 0.20, "downside_vol_20": -0.10}
_OBV = {"obv_slope_20": 0.40, "range_position_20": 0.30, "amount_trend_20": 0.20, "downside_vol_20": -0.10}
_minus = lambda x: {f: -v for f, v in x.items()}

TREND_VOLUME = Family(
    trend_volume_features,
    _TREND_GATE,
    {
        "supertrend_volume_confirmed_10_3_20": _SUPER,
        "smart_money_trend_20": _SMART,
        "obv_breakout_low_tail_20": _OBV,
        "anti_supertrend_volume_confirmed_10_3_20": _minus(_SUPER),
        "anti_smart_money_trend_20": _minus(_SMART),
        "anti_obv_breakout_low_tail_20": _minus(_OBV),
        "supertrend_volume_capacity_strict_10_3_20": _SUPER,
        "obv_breakout_capacity_strict_20": _OBV,
    },
    extra={
        "supertrend_volume_confirmed_10_3_20": "supertrend_on",
        "anti_supertrend_volume_confirmed_10_3_20": "supertrend_on",
        "supertrend_volume_capacity_strict_10_3_20": f"supertrend_on and {_STRICT}",
        "smart_money_trend_20": "momentum_20 > 0",
        "anti_smart_money_trend_20": "momentum_20 > 0",
        "obv_breakout_low_tail_20": "range_position_20 >= 0.60",
        "anti_obv_breakout_low_tail_20": "range_position_20 >= 0.60",
        "obv_breakout_capacity_strict_20": f"range_position_20 >= 0.60 and {_STRICT}",
    },
)


def aroon(c: str, n: int, high: bool) -> Column:
    """100 * place of the first extreme in the frame / n, the oldest row being place 1."""
    frame = w.frame(n)
    age = F.col("bar_no")
    # of equal extremes the oldest counts: the largest (value, -bar number)
    top = F.max(F.struct((F.col(c) if high else -F.col(c)).alias("v"), (-age).alias("a"))).over(frame)
    return F.when(F.count(c).over(frame) >= n, 100.0 * (n - (age + top["a"])) / n)


def trend_strength_features(bars: DataFrame) -> DataFrame:
    p, high, low = F.col("adj_close"), F.col("high"), F.col("low")
    df = w.steps(
        _flow(bars),
        {"tr": true_range(), "up": high - w.lag("high"), "dn": w.lag("low") - low, "bar_no": F.row_number().over(w.by_asset()), "step": F.abs(p - w.lag(p)), "high14": w.highest("high", 14), "low14": w.lowest("low", 14), "width20": w.highest("high", 20) - w.lowest("low", 20)},
        {"plus": F.when((F.col("up") > F.col("dn")) & (F.col("up") > 0), F.col("up")).otherwise(0.0), "minus": F.when((F.col("dn") > F.col("up")) & (F.col("dn") > 0), F.col("dn")).otherwise(0.0), "efficiency": w.clip(div(F.abs(p - w.lag(p, 10)), w.total("step", 10)), 0.0, 1.0)},
        {"di_plus": 100 * div(w.total("plus", 14), w.total("tr", 14)), "di_minus": 100 * div(w.total("minus", 14), w.total("tr", 14))},
        {"dx": 100 * div(F.abs(F.col("di_plus") - F.col("di_minus")), F.col("di_plus") + F.col("di_minus"))},
        {
            "adx_14": w.mean("dx", 14),
            "momentum_20": w.change(p, 20),
            "choppiness_20": 100 * F.log10(F.when(w.total("tr", 20) > 0, div(w.total("tr", 20), "width20"))) / F.log10(F.lit(20.0)),
            "kama_decay": w.highest("efficiency", 30) - F.col("efficiency"),
            "aroon_spread": aroon("low", 25, False) - aroon("high", 25, True),
            "williams_oversold": 100 * div(F.col("high14") - p, F.col("high14") - F.col("low14")),
        },
        {"range_exhaustion": 1 - F.col("range_position_20"), "abs_momentum_20": F.abs("momentum_20")},
    )
    return df


TREND_STRENGTH = Family(
    trend_strength_features,
    "adv20_rank > 0.25 and abs(return_1d) <= 0.50",
    {
        "adx_trend_strength_exhaustion_reversal_14_20": {"adx_14": 0.55, "range_exhaustion": 0.35, "momentum_20": -0.10},
        "adx_choppiness_mean_reversion_quality_14_20": {"choppiness_20": 1.0, "downside_vol_20": -0.50, "abs_momentum_20": -0.25},
        "kama_efficiency_trend_decay_10_30": {"kama_decay": 1.0, "downside_vol_20": -0.25},
        "aroon_range_exhaustion_reversal_25_20": {"aroon_spread": 1.0, "range_exhaustion": 0.35},
        "williams_range_failure_reversal_14_20": {"williams_oversold": 1.0, "downside_vol_20": -0.25},
    },
    averages={"trend_strength_state_residual_composite_20": ("adx_trend_strength_exhaustion_reversal_14_20", "adx_choppiness_mean_reversion_quality_14_20", "kama_efficiency_trend_decay_10_30", "aroon_range_exhaustion_reversal_25_20", "williams_range_failure_reversal_14_20")},
)


def rsrs(bars: DataFrame) -> DataFrame:
    """Slope of highs on lows, its score over its own past, and the score weighted by the fit."""
    df = w.steps(
        bars,
        {"rsrs_slope_18": w.pair_roll(F.regr_slope, "high", "low", 18), "fit": w.roll_corr("high", "low", 18)},
        {"rsrs_zscore_18_60": div(F.col("rsrs_slope_18") - w.mean("rsrs_slope_18", 60, 20), w.std("rsrs_slope_18", 60, 20))},
        {"rsrs_right_skew_18_60": F.col("rsrs_zscore_18_60") * F.pow("fit", F.lit(2)), "rsrs_reversal_18_60": -F.col("rsrs_zscore_18_60")},
    )
    return df.select(*KEYS, "rsrs_slope_18", "rsrs_zscore_18_60", "rsrs_right_skew_18_60", "rsrs_reversal_18_60")


def formula_features(bars: DataFrame) -> DataFrame:
    p = F.col("adj_close")
    low20, high20 = w.lowest("low", 20, 5), w.highest("high", 20, 5)
    df = w.steps(
        bars,
        {"return_1d": w.change(p), "amount_change": w.change("amount"), "momentum_20": w.change(p, 20), "momentum_60": w.change(p, 60), "adv20": w.mean("amount", 20, 5), "hl": div("high", "low") - 1, "range_position_20": div(p - low20, high20 - low20)},
        {"down": F.when(F.col("return_1d").isNotNull(), F.least("return_1d", F.lit(0.0))), "amount_trend_20": div(w.mean("amount", 5, 3), "adv20") - 1, "pv_corr_20": w.roll_corr("return_1d", "amount_change", 20, 10), "hl_range_20": w.mean("hl", 20, 5), "log_adv20": F.log(F.when(F.col("adv20") > 0, F.col("adv20")))},
        {"downside_vol_20": w.std("down", 20, 5), "pv_divergence_20": -F.col("momentum_20") * F.col("amount_trend_20")},
    )
    return df.withColumns({"adv20_rank": w.pct_rank("adv20"), "downside_rank": w.pct_rank("downside_vol_20"), "hl_rank": w.pct_rank("hl_range_20")})


def _plus(*tables: tuple[float, dict[str, float]]) -> dict[str, float]:
    """Sum of weight tables, each with its factor."""
    out: dict[str, float] = {}
    for k, t in tables:
        for f, v in t.items():
            out[f] = out.get(f, 0.0) + k * v
    return out


_TAIL = {"downside_vol_20": -1.0, "hl_range_20": -0.50}
_PV = _plus((1.0, {"pv_divergence_20": 0.70, "pv_corr_20": -0.30}), (0.15, _TAIL))
_CONTRACTION = _plus((1.0, {"momentum_20": -0.45, "amount_trend_20": -0.35}), (0.20, _TAIL))
_RANGE = {"range_position_20": 0.45, "hl_range_20": -0.35, "downside_vol_20": -0.20}
_LIQUID = {"log_adv20": 1.0}
_CONFIRMED = "momentum_60 > 0 and range_position_20 >= 0.45"

FORMULA_PRICE_VOLUME = Family(
    formula_features,
    "adv20_rank >= 0.30 and downside_rank <= 0.90 and (hl_rank <= 0.85 or hl_range_20 <= 0.08) and abs(return_1d) <= 0.50",
    {
        "formula_pv_corr_reversal_20": _PV,
        "formula_volume_contraction_reversal_20": _CONTRACTION,
        "formula_range_contraction_breakout_20": _RANGE,
        "formula_range_contraction_breakout_liquid_20": _plus((1.0, _RANGE), (0.10, _LIQUID)),
        "formula_range_contraction_breakout_lowvol_20": _plus((1.0, _RANGE), (0.10, _TAIL)),
        "formula_range_contraction_breakout_liquid_lowvol_20": _plus((1.0, _RANGE), (0.07, _LIQUID), (0.07, _TAIL)),
        "formula_pv_corr_momentum_confirmed_20_60": _plus((0.50, _PV), (1.0, {"momentum_60": 0.35, "range_position_20": 0.15})),
        "formula_volume_contraction_momentum_confirmed_20_60": _plus((0.45, _CONTRACTION), (1.0, {"momentum_60": 0.40, "range_position_20": 0.15})),
    },
    fill=True,
    extra={"formula_pv_corr_momentum_confirmed_20_60": _CONFIRMED, "formula_volume_contraction_momentum_confirmed_20_60": _CONFIRMED},
)


def _path(r: str, n: int) -> dict[str, Column]:
    """Frame statistics of a path: its length, the share of its largest step, and agreement of its signs.

    Steps and signs are missing where the return is, so one count serves all three.
    """
    over, c = w.frame(n), F.col(r)
    count = F.count(c).over(over)
    enough = count >= max(5, n // 3)
    length, largest = F.sum(F.abs(c)).over(over), F.max(F.abs(c)).over(over)
    return {
        f"length_{n}": F.when(enough, length),
        f"jump_{n}": F.when(enough, w.clip(F.when(length <= 1e-12, 0.0).otherwise(div(largest, length)), 0.0, 1.0)),
        f"signs_{n}": F.when(enough, w.clip(div(F.abs(F.sum(F.signum(c)).over(over)), count.cast("double")), 0.0, 1.0)),
    }


def discreteness_features(bars: DataFrame) -> DataFrame:
    """The path of the 60 rows up to five rows ago is what stood five rows ago, so its frame is not taken again."""
    p = F.col("adj_close")
    smooth = lambda whole, length: w.clip(div(F.abs(whole), length), 0.0, 1.0)
    df = w.steps(
        bars,
        {"return_1d": w.change(p), "return_20": w.change(p, 20), "return_60": w.change(p, 60), "skip5_return_60": div(w.lag(p, 5), w.lag(p, 65)) - 1, "adv20": w.mean("amount", 20, 5)},
        {"amount_trend_20_60": div("adv20", w.mean("amount", 60, 20)) - 1, "realized_vol_20": w.std("return_1d", 20, 5)} | _path("return_1d", 20) | _path("return_1d", 60),
        {f"late_{x}_60": w.lag(f"{x}_60", 5) for x in ("length", "jump", "signs")},
        {"smooth_60": smooth("return_60", "length_60"), "late_smooth_60": smooth("skip5_return_60", "late_length_60")},
        {"continuity_60": 0.5 * F.col("smooth_60") + 0.5 * F.col("signs_60") - F.col("jump_60"), "late_continuity_60": 0.5 * F.col("late_smooth_60") + 0.5 * F.col("late_signs_60") - F.col("late_jump_60")},
    )
    return df.withColumn("adv20_rank", w.pct_rank("adv20"))


INFORMATION_DISCRETENESS = Family(
    discreteness_features,
    "adv20_rank > 0.20 and abs(return_1d) <= 0.50",
    {
        "fip_smooth_momentum_quality_60_20": {"return_60": 1.0, "continuity_60": 0.70, "jump_20": -0.40, "realized_vol_20": -0.25},
        "fip_smooth_momentum_skip5_60": {"skip5_return_60": 1.0, "late_continuity_60": 0.70, "realized_vol_20": -0.25},
        "fip_continuous_accumulation_low_jump_20_60": {"return_20": 1.0, "return_60": 0.50, "continuity_60": 0.70, "jump_20": -0.80},
        "fip_discrete_jump_reversal_20_5": {"return_20": -1.0, "jump_20": 0.80, "realized_vol_20": -0.25},
        "fip_smooth_pullback_resilience_60_20": {"return_60": 1.0, "return_20": -0.60, "continuity_60": 0.50, "jump_20": -0.30},
        "fip_volume_confirmed_smooth_trend_20_60": {"return_60": 1.0, "smooth_60": 0.60, "amount_trend_20_60": 0.50, "jump_20": -0.40},
    },
)


def shock_features(bars: DataFrame) -> DataFrame:
    p = F.col("adj_close")
    df = w.steps(
        bars,
        {"return_1d": w.change(p), "return_5": w.change(p, 5), "return_10": w.change(p, 10), "adv20": w.mean("amount", 20, 5), "adv5": w.mean("amount", 5, 3), "hl": div("high", F.when(F.col("low") > 0, F.col("low"))) - 1},
        {"abs_return_1": F.abs("return_1d"), "amihud": div(F.abs("return_1d"), F.when(F.col("amount") > 0, F.col("amount"))), "down": F.when(F.col("return_1d").isNotNull(), F.least("return_1d", F.lit(0.0))), "hl_range_20": w.mean("hl", 20, 5), "amount_shock_5_20": div("adv5", "adv20") - 1, "liquidity_stability_20": div(w.lowest("amount", 20, 5), "adv20")},
        {"amihud_20": w.mean("amihud", 20, 5), "downside_vol_20": w.std("down", 20, 5), "range_shock_5_20": div(w.highest("hl", 5, 3), "hl_range_20") - 1},
        {"amihud_spike_5_20": div(w.highest("amihud", 5, 3), "amihud_20") - 1},
        {"impact_absorption_5_20": F.col("amihud_spike_5_20") - (div("amihud", "amihud_20") - 1)},
    )
    return df.withColumns({"adv20_rank": w.pct_rank("adv20"), "downside_rank": w.pct_rank("downside_vol_20"), "hl_rank": w.pct_rank("hl_range_20")})


_SHOCK = {
    "amihud_shock_reversal_recovery_20_5": {"return_5": -1.0, "amihud_spike_5_20": 0.75, "impact_absorption_5_20": 0.75, "downside_vol_20": -0.35},
    "volume_shock_absorption_reversal_20_5": {"return_5": -1.0, "amount_shock_5_20": 0.60, "impact_absorption_5_20": 0.60, "abs_return_1": -0.40},
    "range_shock_liquidity_recovery_20_10": {"return_10": -1.0, "range_shock_5_20": 0.65, "liquidity_stability_20": 0.45, "hl_range_20": -0.45},
    "downside_liquidity_resilience_20": {"downside_vol_20": -1.0, "liquidity_stability_20": 0.55, "impact_absorption_5_20": 0.35, "abs_return_1": -0.30},
}

LIQUIDITY_SHOCK = Family(shock_features, "adv20_rank > 0.25 and downside_rank <= 0.90 and hl_rank <= 0.95 and abs_return_1 <= 0.50", _SHOCK, averages={"liquidity_recovery_quality_composite_20": tuple(_SHOCK)})


INDUSTRY = ("date", "market", "industry")


def industry_features(bars: DataFrame) -> DataFrame:
    p = F.col("adj_close")
    low20, high20 = w.lowest(p, 20, 5), w.highest(p, 20, 5)
    return w.steps(
        bars,
        {"return_1d": w.change(p), "return_5": w.change(p, 5), "return_10": w.change(p, 10), "return_20": w.change(p, 20), "return_60": w.change(p, 60), "adv20": w.mean("amount", 20, 5), "range_position_20": div(p - low20, high20 - low20)},
        {"amount_trend_20_60": div("adv20", w.mean("amount", 60, 20)) - 1, "realized_vol_20": w.std("return_1d", 20, 5)},
    )


def industry_breadth(bars: DataFrame, least: int = 8) -> DataFrame:
    """Breadth and dispersion of industries: group aggregate, 20-session mean of the industry's own series, join back."""
    df = industry_features(bars)
    share = lambda c: F.avg(F.coalesce((F.col(c) > 0).cast("double"), F.lit(0.0)))
    state = df.groupBy(*INDUSTRY).agg(F.countDistinct("asset_id").alias("industry_count"), *[F.avg(c).alias(f"i_{c}") for c in ("return_5", "return_10", "return_20", "amount_trend_20_60")], F.stddev_pop("return_20").alias("dispersion"), share("return_20").alias("breadth_20"), share("return_60").alias("breadth_60"))
    past = dict(keys=("market", "industry"))
    state = state.withColumns({"change_20": F.col("breadth_20") - w.mean("breadth_20", 20, 5, **past), "change_60": F.col("breadth_60") - w.mean("breadth_60", 20, 5, **past)})
    df = df.join(state, list(INDUSTRY)).withColumns({f"idio_{n}": F.col(f"return_{n}") - F.col(f"i_return_{n}") for n in (5, 10, 20)})
    df = df.withColumns({"dispersion_z": w.zscore("dispersion"), "breadth_20_z": w.zscore("breadth_20"), "breadth_60_z": w.zscore("breadth_60")})
    c = F.col
    raw = {
        "industry_breadth_repair_laggard_rebound_20": 0.70 * c("change_20") + 0.35 * c("change_60") - 0.45 * c("idio_20") - 0.20 * c("realized_vol_20"),
        "industry_breadth_volume_confirmed_repair_20": c("change_20") * (1 + w.clip("i_amount_trend_20_60", -0.5, 1.0)) - 0.35 * c("idio_20"),
        "industry_dispersion_compression_breakout_20": -0.65 * c("dispersion_z") + 0.45 * c("change_20") + 0.30 * c("idio_5") - 0.20 * c("realized_vol_20"),
        "industry_internal_dispersion_laggard_reversal_20": 0.70 * c("dispersion_z") - 0.55 * c("idio_20") + 0.25 * c("change_20") - 0.20 * c("realized_vol_20"),
        "industry_breadth_overheat_runup_avoidance_10": -(0.70 * c("breadth_20_z") + 0.50 * c("breadth_60_z") + 0.45 * c("idio_10") + 0.20 * w.clip("amount_trend_20_60", -0.5, 1.5)),
        "industry_breadth_turning_point_resilience_20": 0.55 * c("change_20") + 0.35 * c("i_return_5") + 0.30 * c("idio_5") - 0.25 * c("realized_vol_20"),
    }
    valid = (c("industry_count") >= least) & (c("adv20") > 0)
    df = df.withColumns(raw)
    return df.select(*KEYS, *[F.when(valid, w.zscore(n)).alias(n) for n in raw])


def industry_leaders(bars: DataFrame, quantile: float = 0.67, least: int = 3) -> DataFrame:
    """Gap of each asset to its industry's leaders, which are weighted by traded amount and leave the asset out."""
    c = F.col
    df = industry_features(bars).withColumns({"industry_count": F.count("asset_id").over(w.cross(INDUSTRY)), "adv_rank": w.pct_rank("adv20", INDUSTRY), "dispersion": F.stddev_pop("return_20").over(w.cross(INDUSTRY))})
    df = df.withColumn("leads", F.coalesce((c("industry_count") >= least) & (c("adv_rank") >= quantile), F.lit(False)))
    df = df.withColumn("weight", F.when(c("leads"), F.coalesce("adv20", F.lit(0.0))).otherwise(0.0))
    group = w.cross(INDUSTRY)
    lead = {}
    for name in ("return_5", "return_10", "return_20", "amount_trend_20_60", "range_position_20"):
        total, value = F.sum("weight").over(group), F.sum(c("weight") * c(name)).over(group)
        rest = total - c("weight")
        lead[f"l_{name}"] = F.when(rest > 0, (value - c("weight") * c(name)) / rest).otherwise(value / F.when(total > 0, total))
    df = df.withColumns(lead | {"leaders": F.sum(c("leads").cast("int")).over(group)})
    raw = {
        "industry_leader_laggard_gap_reversion_5_20": c("l_return_5") - c("return_5") + 0.25 * (c("l_return_20") - c("return_20")),
        "industry_leader_breakout_laggard_followthrough_10_5": 0.65 * c("l_return_10") + 0.25 * c("l_range_position_20") - 0.45 * c("return_5"),
        "industry_leader_volume_confirmed_diffusion_5_20": c("l_return_5") * (1 + w.clip("l_amount_trend_20_60", -0.5)) - c("return_5"),
        "industry_peer_dispersion_compression_reversal_20_5": c("dispersion") * (c("l_return_5") - c("return_5")) - 0.25 * c("realized_vol_20"),
        "industry_leader_pullback_resilience_10_5": c("l_return_10") - w.clip("return_5", high=0.0) - 0.20 * c("realized_vol_20"),
        "industry_laggard_lowvol_catchup_composite_20": 0.45 * (c("l_return_20") - c("return_20")) + 0.25 * (c("l_return_5") - c("return_5")) - 0.30 * c("realized_vol_20"),
    }
    valid = (c("industry_count") >= least) & (c("leaders") > 0) & c("adv20").isNotNull()
    df = df.withColumns(raw)
    return df.select(*KEYS, *[F.when(valid, w.zscore(n)).alias(n) for n in raw])
