"""Factor families and their SQL. The SQL states features and gates itself; the fixed weights are the families' own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import panel
from ..operators import families as f
from . import sqltext as s
from .registry import register, rounded

KEYS = ["asset_id", "market", "date"]
R, L, C = s.roll, s.lag, s.change
P = "adj_close"


def _score_sql(family: f.Family, stages: list[dict[str, str]], gate: str, extra: dict[str, str] | None = None, where: str = "") -> str:
    def text(name: str) -> str:
        z = (lambda x: f"coalesce(z_{x}, 0)") if family.fill else (lambda x: f"z_{x}")
        terms = " + ".join(f"({v!r}) * {z(k)}" for k, v in family.scores[name].items())
        also = f" AND ({extra[name]})" if extra and name in extra else ""
        return f"CASE WHEN ({gate}){also} THEN {terms} END"

    used = sorted({k for t in family.scores.values() for k in t})
    parts = [*stages, {f"z_{k}": s.z(k) for k in used}, {n: text(n) for n in family.scores}]
    for name, of in (family.averages or {}).items():
        parts.append({name: f"({' + '.join(f'coalesce({x}, 0)' for x in of)}) / nullif({' + '.join(f'CAST({x} IS NOT NULL AS INTEGER)' for x in of)}, 0)"})
    return s.final(parts, list(family.names))


def _family(name: str, family: f.Family, stages: list[dict[str, str]], gate: str, extra: dict[str, str] | None = None) -> None:
    @register(name, _score_sql(family, stages, gate, extra))
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(family.compute(panel.bars(spark, sf_dir)), KEYS, list(family.names))


OSC = [
    {"move": f"{P} - {L(P)}", "upper_20": R("max", "high", 20), "lower_20": R("min", "low", 20), "center": R("avg", P, 20), "width": R("stddev_pop", P, 20)},
    {"gain": "CASE WHEN move IS NOT NULL THEN greatest(move, 0) END", "loss": "CASE WHEN move IS NOT NULL THEN -least(move, 0) END"},
    {"ag": R("avg", "gain", 14), "al": R("avg", "loss", 14)},
    {"rsi_reversal_14": "100 - CASE WHEN ag IS NULL OR al IS NULL THEN NULL WHEN al = 0 AND ag > 0 THEN 100 WHEN ag = 0 AND al > 0 THEN 0 WHEN ag = 0 AND al = 0 THEN 50 ELSE 100 - 100 / (1 + ag / nullif(al, 0)) END",
     "bollinger_reversal_20": f"-({P} - center) / nullif(width, 0)", "donchian_position_20": f"CASE WHEN upper_20 > lower_20 THEN greatest(0, least(1, ({P} - lower_20) / (upper_20 - lower_20))) END"},
]

#: Exponential means in closed form: the weights of the past add up to a running sum.
_EMA = lambda x, i, n, over: f"pow({1 - 2 / (n + 1)!r}, {i}) * sum({x} * CASE WHEN {i} = 0 THEN 1 ELSE {2 / (n + 1)!r} END * pow({1 - 2 / (n + 1)!r}, -{i})) OVER ({over} ROWS UNBOUNDED PRECEDING)"
_MACD = [
    {"i": f"row_number() OVER ({s.ASSET}) - 1"},
    {"fast": _EMA(P, "i", 12, s.ASSET), "slow": _EMA(P, "i", 26, s.ASSET)},
    {"line": "CASE WHEN i >= 25 THEN fast - slow END", "j": "CASE WHEN i >= 25 THEN i - 25 END"},
    {"signal": _EMA("line", "j", 9, s.ASSET)},
    {"macd_histogram_12_26_9": "CASE WHEN j >= 8 THEN line - signal END"},
]
_OSC_NAMES = ["rsi_reversal_14", "bollinger_reversal_20", "donchian_position_20", "macd_histogram_12_26_9"]


@register("factors_public_technical", s.final([*OSC, *_MACD], _OSC_NAMES, digits=5))
def public_technical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(f.public_technical(panel.bars(spark, sf_dir)), KEYS, _OSC_NAMES, 5)


FLOW = [
    {"return_1d": C(P), "adv20": R("avg", "amount", 20), "hl": "high / nullif(low, 0) - 1", "range_position_20": f"({P} - {R('min', 'low', 20)}) / nullif({R('max', 'high', 20)} - {R('min', 'low', 20)}, 0)"},
    {"down": "CASE WHEN return_1d IS NOT NULL THEN least(return_1d, 0) END", "log_adv20": "CASE WHEN adv20 > 0 THEN ln(adv20) END"},
    {"downside_vol_20": R("stddev_pop", "down", 20), "hl_range_20": R("avg", "hl", 20)},
    {"adv20_rank": s.rank("adv20"), "downside_rank": s.rank("downside_vol_20"), "hl_rank": s.rank("hl_range_20")},
]
_family("factors_technical_liquidity", f.TECHNICAL_LIQUIDITY, [*OSC, *FLOW], "adv20_rank >= 0.6 AND abs(return_1d) <= 0.5")
_family("factors_technical_tail_guard", f.TECHNICAL_TAIL_GUARD, [*OSC, *FLOW], "adv20_rank >= 0.5 AND downside_rank <= 0.75 AND hl_rank <= 0.75 AND range_position_20 >= 0.15 AND abs(return_1d) <= 0.5")

_TR = f"CASE WHEN {L(P)} IS NULL THEN high - low ELSE greatest(high - low, abs(high - {L(P)}), abs(low - {L(P)})) END"
_STRICT = "adv20_rank >= 0.8 AND downside_rank <= 0.6 AND (hl_rank <= 0.7 OR hl_range_20 <= 0.05) AND amount_stability_20 >= 0.25 AND abs(return_1d) <= 0.2"
_family(
    "factors_trend_volume",
    f.TREND_VOLUME,
    [
        *FLOW,
        {"tr": _TR, "signed": "sign(coalesce(return_1d, 0)) * amount", "fin": "CASE WHEN return_1d > 0 THEN amount ELSE 0 END", "fout": "CASE WHEN return_1d < 0 THEN amount ELSE 0 END"},
        {"atr": R("avg", "tr", 10), "mid": f"({R('max', 'high', 10)} + {R('min', 'low', 10)}) / 2", "obv": f"sum(signed) OVER ({s.ASSET} ROWS UNBOUNDED PRECEDING)", "pin": R("sum", "fin", 20), "pout": R("sum", "fout", 20)},
        {"momentum_20": C(P, 20), "amount_stability_20": f"{R('min', 'amount', 20)} / nullif(adv20, 0)", "amount_trend_20": f"{R('avg', 'amount', 5)} / nullif(adv20, 0) - 1", "smart_money_pressure_20": "(pin - pout) / nullif(pin + pout, 0)", "obv_slope_20": f"(obv - {L('obv', 20)}) / nullif({R('sum', 'amount', 20)}, 0)", "supertrend_distance": f"({P} - (mid - 3 * atr)) / nullif(atr, 0)", "st_on": f"{P} > mid - 3 * atr AND {P} > {R('avg', P, 20)}"},
    ],
    "adv20_rank >= 0.5 AND downside_rank <= 0.75 AND (hl_rank <= 0.85 OR hl_range_20 <= 0.08) AND abs(return_1d) <= 0.5",
    {"supertrend_volume_confirmed_10_3_20": "st_on", "anti_supertrend_volume_confirmed_10_3_20": "st_on", "supertrend_volume_capacity_strict_10_3_20": f"st_on AND {_STRICT}", "smart_money_trend_20": "momentum_20 > 0", "anti_smart_money_trend_20": "momentum_20 > 0", "obv_breakout_low_tail_20": "range_position_20 >= 0.6", "anti_obv_breakout_low_tail_20": "range_position_20 >= 0.6", "obv_breakout_capacity_strict_20": f"range_position_20 >= 0.6 AND {_STRICT}"},
)

_W25 = f"OVER ({s.ASSET} ROWS BETWEEN 24 PRECEDING AND CURRENT ROW)"
_first = lambda c, agg: f"CASE WHEN count({c}) {_W25} >= 25 THEN 100.0 * list_position(list({c}) {_W25}, {agg}({c}) {_W25}) / 25 END"
_family(
    "factors_trend_strength",
    f.TREND_STRENGTH,
    [
        *FLOW,
        {"tr": _TR, "up": f"high - {L('high')}", "dn": f"{L('low')} - low", "step": f"abs({P} - {L(P)})", "h14": R("max", "high", 14), "l14": R("min", "low", 14), "w20": f"{R('max', 'high', 20)} - {R('min', 'low', 20)}"},
        {"plus": "CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END", "minus": "CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END", "eff": f"CASE WHEN {L(P, 10)} IS NOT NULL THEN greatest(0, least(1, abs({P} - {L(P, 10)}) / nullif({R('sum', 'step', 10)}, 0))) END"},
        {"dip": f"100 * {R('sum', 'plus', 14)} / nullif({R('sum', 'tr', 14)}, 0)", "dim": f"100 * {R('sum', 'minus', 14)} / nullif({R('sum', 'tr', 14)}, 0)"},
        {"dx": "100 * abs(dip - dim) / nullif(dip + dim, 0)"},
        {"adx_14": R("avg", "dx", 14), "momentum_20": C(P, 20), "choppiness_20": f"100 * log10(CASE WHEN {R('sum', 'tr', 20)} > 0 THEN {R('sum', 'tr', 20)} / nullif(w20, 0) END) / log10(20.0)", "kama_decay": f"{R('max', 'eff', 30)} - eff", "aroon_spread": f"{_first('low', 'min')} - {_first('high', 'max')}", "williams_oversold": f"100 * (h14 - {P}) / nullif(h14 - l14, 0)", "range_exhaustion": "1 - range_position_20"},
        {"abs_momentum_20": "abs(momentum_20)"},
    ],
    "adv20_rank > 0.25 AND abs(return_1d) <= 0.5",
)

_RS = ["rsrs_slope_18", "rsrs_zscore_18_60", "rsrs_right_skew_18_60", "rsrs_reversal_18_60"]
_W18 = f"OVER ({s.ASSET} ROWS BETWEEN 17 PRECEDING AND CURRENT ROW)"
_PAIR = lambda agg: f"CASE WHEN count(*) {_W18} >= 18 AND min(low) {_W18} < max(low) {_W18} AND min(high) {_W18} < max(high) {_W18} THEN {agg} {_W18} END"


@register("factors_rsrs", s.final([{"rsrs_slope_18": _PAIR("regr_slope(high, low)"), "fit": _PAIR("corr(high, low)")}, {"rsrs_zscore_18_60": f"(rsrs_slope_18 - {R('avg', 'rsrs_slope_18', 60, 20)}) / nullif({R('stddev_pop', 'rsrs_slope_18', 60, 20)}, 0)"}, {"rsrs_right_skew_18_60": "rsrs_zscore_18_60 * fit * fit", "rsrs_reversal_18_60": "-rsrs_zscore_18_60"}], _RS))
def rsrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(f.rsrs(panel.bars(spark, sf_dir)), KEYS, _RS)


_W20 = f"OVER ({s.ASSET} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
_ranks = {"adv20_rank": s.rank("adv20"), "downside_rank": s.rank("downside_vol_20"), "hl_rank": s.rank("hl_range_20")}
_confirmed = "momentum_60 > 0 AND range_position_20 >= 0.45"
_family(
    "factors_formula_price_volume",
    f.FORMULA_PRICE_VOLUME,
    [
        {"return_1d": C(P), "amount_change": C("amount"), "momentum_20": C(P, 20), "momentum_60": C(P, 60), "adv20": R("avg", "amount", 20, 5), "hl": "high / nullif(low, 0) - 1", "range_position_20": f"({P} - {R('min', 'low', 20, 5)}) / nullif({R('max', 'high', 20, 5)} - {R('min', 'low', 20, 5)}, 0)"},
        {"down": "CASE WHEN return_1d IS NOT NULL THEN least(return_1d, 0) END", "amount_trend_20": f"{R('avg', 'amount', 5, 3)} / nullif(adv20, 0) - 1", "pv_corr_20": f"CASE WHEN count(return_1d) {_W20} >= 10 AND min(return_1d) {_W20} < max(return_1d) {_W20} AND min(amount_change) {_W20} < max(amount_change) {_W20} THEN corr(return_1d, amount_change) {_W20} END", "hl_range_20": R("avg", "hl", 20, 5), "log_adv20": "CASE WHEN adv20 > 0 THEN ln(adv20) END"},
        {"downside_vol_20": R("stddev_pop", "down", 20, 5), "pv_divergence_20": "-momentum_20 * amount_trend_20"},
        _ranks,
    ],
    "adv20_rank >= 0.3 AND downside_rank <= 0.9 AND (hl_rank <= 0.85 OR hl_range_20 <= 0.08) AND abs(return_1d) <= 0.5",
    {"formula_pv_corr_momentum_confirmed_20_60": _confirmed, "formula_volume_contraction_momentum_confirmed_20_60": _confirmed},
)


def _path(pre: str, r: str, n: int, whole: str) -> dict[str, str]:
    least = max(5, n // 3)
    length, top = R("sum", f"abs({r})", n, least), R("max", f"abs({r})", n, least)
    count = f"count({r}) OVER ({s.ASSET} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    unit = lambda e: f"CASE WHEN {e} IS NOT NULL THEN greatest(0, least(1, {e})) END"
    return {f"{pre}smooth_{n}": unit(f"(abs({whole}) / nullif({length}, 0))"), f"{pre}signs_{n}": unit(f"(abs({R('sum', f'sign({r})', n, least)}) / nullif({count}, 0))"), f"{pre}jump_{n}": f"CASE WHEN {length} IS NULL THEN NULL WHEN {length} <= 1e-12 THEN 0 ELSE greatest(0, least(1, {top} / {length})) END"}


_family(
    "factors_information_discreteness",
    f.INFORMATION_DISCRETENESS,
    [
        {"return_1d": C(P), "return_20": C(P, 20), "return_60": C(P, 60), "skip5_return_60": f"{L(P, 5)} / nullif({L(P, 65)}, 0) - 1", "adv20": R("avg", "amount", 20, 5)},
        {"late": L("return_1d", 5), "amount_trend_20_60": f"adv20 / nullif({R('avg', 'amount', 60, 20)}, 0) - 1", "realized_vol_20": R("stddev_pop", "return_1d", 20, 5)},
        _path("", "return_1d", 20, "return_20") | _path("", "return_1d", 60, "return_60") | _path("late_", "late", 60, "skip5_return_60"),
        {"continuity_60": "0.5 * smooth_60 + 0.5 * signs_60 - jump_60", "late_continuity_60": "0.5 * late_smooth_60 + 0.5 * late_signs_60 - late_jump_60", "adv20_rank": s.rank("adv20")},
    ],
    "adv20_rank > 0.2 AND abs(return_1d) <= 0.5",
)
_family(
    "factors_liquidity_shock",
    f.LIQUIDITY_SHOCK,
    [
        {"return_1d": C(P), "return_5": C(P, 5), "return_10": C(P, 10), "adv20": R("avg", "amount", 20, 5), "adv5": R("avg", "amount", 5, 3), "hl": "CASE WHEN low > 0 THEN high / low - 1 END"},
        {"abs_return_1": "abs(return_1d)", "amihud": "CASE WHEN amount > 0 THEN abs(return_1d) / amount END", "down": "CASE WHEN return_1d IS NOT NULL THEN least(return_1d, 0) END", "hl_range_20": R("avg", "hl", 20, 5), "amount_shock_5_20": "adv5 / nullif(adv20, 0) - 1", "liquidity_stability_20": f"{R('min', 'amount', 20, 5)} / nullif(adv20, 0)"},
        {"amihud_20": R("avg", "amihud", 20, 5), "downside_vol_20": R("stddev_pop", "down", 20, 5), "range_shock_5_20": f"{R('max', 'hl', 5, 3)} / nullif(hl_range_20, 0) - 1"},
        {"amihud_spike_5_20": f"{R('max', 'amihud', 5, 3)} / nullif(amihud_20, 0) - 1"},
        {"impact_absorption_5_20": "amihud_spike_5_20 - (amihud / nullif(amihud_20, 0) - 1)", **_ranks},
    ],
    "adv20_rank > 0.25 AND downside_rank <= 0.9 AND hl_rank <= 0.95 AND abs_return_1 <= 0.5",
)

_IND = [
    {"return_1d": C(P), "return_5": C(P, 5), "return_10": C(P, 10), "return_20": C(P, 20), "return_60": C(P, 60), "adv20": R("avg", "amount", 20, 5), "range_position_20": f"({P} - {R('min', P, 20, 5)}) / nullif({R('max', P, 20, 5)} - {R('min', P, 20, 5)}, 0)"},
    {"amount_trend_20_60": f"adv20 / nullif({R('avg', 'amount', 60, 20)}, 0) - 1", "realized_vol_20": R("stddev_pop", "return_1d", 20, 5)},
]
_BREADTH = ["industry_breadth_repair_laggard_rebound_20", "industry_breadth_volume_confirmed_repair_20", "industry_dispersion_compression_breakout_20", "industry_internal_dispersion_laggard_reversal_20", "industry_breadth_overheat_runup_avoidance_10", "industry_breadth_turning_point_resilience_20"]
_past = lambda c: R("avg", c, 20, 5, "PARTITION BY market, industry ORDER BY date")
_valid = lambda e, v: f"CASE WHEN {v} THEN {s.z(e)} END"
_BREADTH_SQL = (
    s.chain(_IND)
    + f""",
st0 AS (SELECT date, market, industry, count(DISTINCT asset_id) AS industry_count, avg(return_5) AS i5, avg(return_10) AS i10, avg(return_20) AS i20, avg(amount_trend_20_60) AS iat, stddev_pop(return_20) AS disp,
  avg(CASE WHEN return_20 > 0 THEN 1.0 ELSE 0.0 END) AS b20, avg(CASE WHEN return_60 > 0 THEN 1.0 ELSE 0.0 END) AS b60 FROM last GROUP BY ALL),
st AS (SELECT *, b20 - {_past('b20')} AS ch20, b60 - {_past('b60')} AS ch60 FROM st0),
j AS (SELECT * FROM last JOIN st USING (date, market, industry)),
k AS (SELECT *, return_5 - i5 AS id5, return_10 - i10 AS id10, return_20 - i20 AS id20, {s.z('disp')} AS dz, {s.z('b20')} AS z20, {s.z('b60')} AS z60 FROM j),
raw AS (SELECT *, 0.7 * ch20 + 0.35 * ch60 - 0.45 * id20 - 0.2 * realized_vol_20 AS f1, CASE WHEN iat IS NOT NULL THEN ch20 * (1 + greatest(-0.5, least(1.0, iat))) - 0.35 * id20 END AS f2,
  -0.65 * dz + 0.45 * ch20 + 0.3 * id5 - 0.2 * realized_vol_20 AS f3, 0.7 * dz - 0.55 * id20 + 0.25 * ch20 - 0.2 * realized_vol_20 AS f4,
  CASE WHEN amount_trend_20_60 IS NOT NULL THEN -(0.7 * z20 + 0.5 * z60 + 0.45 * id10 + 0.2 * greatest(-0.5, least(1.5, amount_trend_20_60))) END AS f5, 0.55 * ch20 + 0.35 * i5 + 0.3 * id5 - 0.25 * realized_vol_20 AS f6 FROM k)
SELECT asset_id, market, date, {', '.join(f"round({_valid(f'f{i + 1}', 'industry_count >= 3 AND adv20 > 0')}, 6) + 0.0 AS {n}" for i, n in enumerate(_BREADTH))} FROM raw"""
)


@register("factors_industry_breadth", _BREADTH_SQL)
def industry_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(f.industry_breadth(panel.bars(spark, sf_dir), least=3), KEYS, _BREADTH)


_LEAD = ["industry_leader_laggard_gap_reversion_5_20", "industry_leader_breakout_laggard_followthrough_10_5", "industry_leader_volume_confirmed_diffusion_5_20", "industry_peer_dispersion_compression_reversal_20_5", "industry_leader_pullback_resilience_10_5", "industry_laggard_lowvol_catchup_composite_20"]
_I = "OVER (PARTITION BY date, market, industry)"
_lead = lambda c: f"CASE WHEN sum(wt) {_I} - wt > 0 THEN (sum(wt * {c}) {_I} - wt * {c}) / (sum(wt) {_I} - wt) ELSE sum(wt * {c}) {_I} / CASE WHEN sum(wt) {_I} > 0 THEN sum(wt) {_I} END END"


@register("factors_industry_leaders", s.chain([
    *_IND,
    {"industry_count": f"count(asset_id) {_I}", "adv_rank": s.rank("adv20", "date, market, industry"), "disp": f"stddev_pop(return_20) {_I}"},
    {"leads": "CASE WHEN industry_count >= 3 AND adv_rank >= 0.67 THEN 1 ELSE 0 END"},
    {"wt": "CASE WHEN leads = 1 THEN coalesce(adv20, 0) ELSE 0 END"},
    {"l5": _lead("return_5"), "l10": _lead("return_10"), "l20": _lead("return_20"), "lat": _lead("amount_trend_20_60"), "lrp": _lead("range_position_20"), "leaders": f"sum(leads) {_I}"},
    {"f1": "l5 - return_5 + 0.25 * (l20 - return_20)", "f2": "0.65 * l10 + 0.25 * lrp - 0.45 * return_5", "f3": "CASE WHEN lat IS NOT NULL THEN l5 * (1 + greatest(lat, -0.5)) - return_5 END", "f4": "disp * (l5 - return_5) - 0.25 * realized_vol_20", "f5": "CASE WHEN return_5 IS NOT NULL THEN l10 - least(return_5, 0) - 0.2 * realized_vol_20 END", "f6": "0.45 * (l20 - return_20) + 0.25 * (l5 - return_5) - 0.3 * realized_vol_20"},
]) + f"\nSELECT asset_id, market, date, {', '.join(f'''round({_valid(f'f{i + 1}', 'industry_count >= 3 AND leaders > 0 AND adv20 IS NOT NULL')}, 6) + 0.0 AS {n}''' for i, n in enumerate(_LEAD))} FROM last")
def industry_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(f.industry_leaders(panel.bars(spark, sf_dir)), KEYS, _LEAD)
