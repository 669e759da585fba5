"""Price and volume factors of one window length, as columns.

Rolling statistics come first, then what compares the assets of a date and market. Only requested columns are kept, so
Catalyst prunes the windows of the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.windows import div

KEYS = ["asset_id", "market", "date"]

DIRECT = (
    "momentum", "reversal", "risk_adjusted_momentum", "volatility", "low_volatility", "low_downside_volatility", "drawdown_resilience",
    "volume_change", "liquidity", "high_liquidity", "liquidity_resilience", "amount_stability", "average_amount", "crash_recovery",
    "recovery_quality", "demand_pressure", "quiet_accumulation",
)
RELATIVE = ("market_relative_strength", "momentum_dispersion_breakout")
GATED = ("market_relative_strength", "crash_recovery", "recovery_quality", "demand_pressure", "quiet_accumulation")
STATE = ("state_adaptive_trend_defense", "state_stress_defensive_resilience", "state_stress_recovery_leadership")
COMPOSITE = {
    "trend_resilience": ("momentum", "drawdown_resilience", "liquidity_resilience"),
    "risk_confirmed_momentum": ("risk_adjusted_momentum", "drawdown_resilience", "amount_stability"),
    "defensive_reversal": ("reversal", "low_downside_volatility", "liquidity_resilience"),
    "liquidity_confirmed_breakout": ("momentum", "amount_stability", "liquidity_resilience"),
}
NAMES = (*DIRECT, *RELATIVE, *(f"liquid_{g}" for g in GATED), *STATE, *COMPOSITE)


def _among(columns: list[str], out: Column) -> Column:
    """``out`` where all of ``columns`` are present: only such rows take part in a cross-section."""
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    return F.when(whole, out)


def technical(bars: DataFrame, n: int, names: tuple[str, ...] | None = None, parts: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Keys and one column per factor, without the window length in its name.

    parts: partitions of the cross-sections (see windows.deal). keep: columns of the bars to give out as well, beside factors
    that need no cross-section.
    """
    unknown = sorted(set(names or ()) - set(NAMES))
    if unknown:
        raise ValueError(f"unknown technical factors: {', '.join(unknown)}")
    half, short = max(1, n // 2), max(2, n // 3)
    p, amount = F.col("adj_close"), F.col("amount")
    df = w.steps(
        bars,
        {"ret": w.change(p), "paid": F.nullif(amount, F.lit(0.0)), "momentum": w.change(p, n), "mom_half": w.change(p, half), "mom_short": w.change(p, short), "high_n": w.highest(p, n), "volume_change": div("volume", w.mean("volume", n)) - 1},
        {
            "down": F.least("ret", F.lit(0.0)),
            "amihud": div(F.abs("ret"), "paid"),
            "paid_change": w.change("paid"),
            "recent": w.mean("paid", half),
            "positive": F.when(amount > 0, amount),
            "drawdown_resilience": div(p, "high_n") - 1,
            "volatility": w.std("ret", n),
        },
        {
            "down": F.when(F.col("ret").isNotNull(), F.col("down")),
            "liquidity": w.mean("amihud", n),
            "amount_stability": -w.std("paid_change", n),
            "average_amount": F.log1p(w.mean("positive", n)),
            "acceleration": F.log(div("recent", w.lag("recent", half))),
        },
        {"down_sd": w.std("down", n)},
        {
            "reversal": -F.col("momentum"),
            "risk_adjusted_momentum": div("momentum", "volatility"),
            "low_volatility": -F.col("volatility"),
            "low_downside_volatility": -F.col("down_sd"),
            "high_liquidity": -F.col("liquidity"),
            "liquidity_resilience": -F.col("amihud"),
            "crash_recovery": F.col("mom_short") * -F.least("drawdown_resilience", F.lit(0.0)),
            "recovery_quality": div("mom_short", "down_sd") + F.col("drawdown_resilience"),
            "demand_pressure": F.col("mom_half") * F.col("acceleration"),
            "quiet_accumulation": F.col("acceleration") - F.col("volatility"),
        },
        {"crash_recovery": F.when(F.col("drawdown_resilience").isNotNull(), F.col("crash_recovery"))},
    )
    wanted = names or NAMES
    if set(wanted) <= set(DIRECT):
        return df.select(*KEYS, *keep, *wanted)
    if keep:
        raise ValueError("columns are kept beside factors of single assets only")
    df = w.steps(
        w.deal(df.select(*KEYS, *DIRECT), parts),
        {"market_momentum": F.median("momentum").over(w.cross()), "momentum_sd": F.stddev_pop("momentum").over(w.cross())},
        {"market_relative_strength": F.col("momentum") - F.col("market_momentum")},
        {"momentum_dispersion_breakout": div("market_relative_strength", "momentum_sd")},
    )
    halves, gates = {}, {}
    for g in GATED:
        for c in ("average_amount", "liquidity_resilience"):
            halves[f"{g}_{c}"] = _among([g, "average_amount", "liquidity_resilience"], F.col(c))
        gates[f"liquid_{g}"] = F.when(F.col(f"{g}_average_amount") & F.col(f"{g}_liquidity_resilience"), F.col(g))
    ranked = ["momentum", "market_relative_strength", "drawdown_resilience", "low_downside_volatility", "liquidity_resilience", "crash_recovery", "recovery_quality"]
    medians = {"m_momentum": F.median(_among(ranked, F.col("momentum"))).over(w.cross()), "m_drawdown": F.median(_among(ranked, F.col("drawdown_resilience"))).over(w.cross())}
    values, middle, counts, flags = w.upper_half(halves)
    df = w.steps(df, values, middle | medians, counts, flags, gates)
    state = any(name in STATE for name in wanted)
    ranks = {f"r_{c}": _among(ranked, F.col(c)) for c in ranked} if state else {}
    made = {name: cs for name, cs in COMPOSITE.items() if name in wanted}
    for name, cs in made.items():
        ranks |= {f"r_{name}_{c}": _among(list(cs), F.col(c)) for c in cs}
    needed = [c for c in wanted if c not in STATE and c not in COMPOSITE]
    df = w.pct_ranks(df.select(*KEYS, *needed, *(medians if state else ()), *[v.alias(f"v_{r}") for r, v in ranks.items()]), {r: F.col(f"v_{r}") for r in ranks})
    if state:
        stress = (F.col("m_momentum") < 0) | (F.col("m_drawdown") < -0.05)
        df = w.steps(
            df,
            {"s_trend": w.row_mean("r_momentum", "r_market_relative_strength"), "s_defense": w.row_mean("r_drawdown_resilience", "r_low_downside_volatility", "r_liquidity_resilience"), "s_recovery": w.row_mean("r_crash_recovery", "r_recovery_quality", "r_drawdown_resilience")},
            {"state_adaptive_trend_defense": F.when(F.col("m_momentum") >= 0, F.col("s_trend")).otherwise(F.col("s_defense")), "state_stress_defensive_resilience": F.when(stress, F.col("s_defense")), "state_stress_recovery_leadership": F.when(stress, F.col("s_recovery"))},
        )
    df = df.withColumns({name: w.row_mean(*[f"r_{name}_{c}" for c in cs]) for name, cs in made.items()}) if made else df
    return df.select(*KEYS, *wanted)


def long_form(wide: DataFrame, names: list[str], lookback: int, suffix: str = "", keep: tuple[str, ...] = ()) -> DataFrame:
    """(date, asset_id, market, factor_name, factor_value, lookback_window, kept columns), one row per factor."""
    renamed = wide.select(*KEYS, *keep, *[F.col(n).cast("double").alias(f"{n}{suffix}") for n in names])
    out = renamed.unpivot([*KEYS, *keep], [f"{n}{suffix}" for n in names], "factor_name", "factor_value").withColumn("lookback_window", F.lit(lookback))
    return out.select(*[c for c in out.columns if c not in keep], *keep)
