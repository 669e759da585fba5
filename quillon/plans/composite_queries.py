"""Scores of price behaviour with valuation or money flow, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import panel
from ..operators import composites as c
from . import sqltext as s
from .input_queries import _INV, _MF, _MFE, _VALUED, _VF, _valued_family, flows, valued
from .registry import SQL, register, rounded

KEYS = ["asset_id", "market", "date"]
R, L, C, P = s.roll, s.lag, s.change, "adj_close"

_CHAMPION = [
    {"return_1d": C(P), "momentum_20": C(P, 20), "range_low_20": f"-({P} - {R('min', P, 20)}) / nullif({R('max', P, 20)} - {R('min', P, 20)}, 0)", "pb_inv": _INV("pb"), "pe_inv": _INV("pe_ttm")},
    {"down": "CASE WHEN return_1d IS NOT NULL THEN least(return_1d, 0) END"},
    {"downside_low_20": f"-{R('stddev_pop', 'down', 20)}"},
    {"amount_rank": s.rank("amount"), "momentum_rank": s.rank("momentum_20"), "turnover_rank": s.rank("turnover_rate")},
    {"turnover_band": "-abs(turnover_rank - 0.3)", "amount_mid": "-abs(amount_rank - 0.6)"},
    {f"z_{k}": s.z(k) for k in ("pb_inv", "pe_inv", "turnover_band", "amount_mid", "downside_low_20", "range_low_20")},
    {"v": "CASE WHEN amount_rank BETWEEN 0.3 AND 0.9 AND momentum_rank BETWEEN 0.1 AND 0.8 AND turnover_rank <= 0.8 THEN z_pb_inv + z_pe_inv + z_turnover_band + z_amount_mid + z_downside_low_20 + 0.5 * z_range_low_20 END"},
]


@register("factors_champion", s.chain(_CHAMPION, start="valued", head=_VALUED) + "\nSELECT asset_id, market, date, round(v, 6) + 0.0 AS rankic_neg1_downside_range_blend FROM last")
def factors_champion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(c.CHAMPION.compute(valued(spark, sf_dir)), KEYS, list(c.CHAMPION.names))


_PRESSURE = [
    *_VF,
    {"close_location": f"greatest(0, least(1, ({P} - low) / nullif(high - low, 0))) - 0.5 + 0 * ({P} - low) / nullif(high - low, 0)", "amount_trend_20": "adv5 / nullif(adv20, 0) - 1"},
    {"paid_location": "close_location * CASE WHEN amount > 0 THEN ln(1 + amount) END"},
    {"close_location_20": R("avg", "close_location", 20, 5), "pressure_20": R("avg", "paid_location", 20, 5)},
]
_valued_family("factors_smart_money", c.SMART_MONEY, "adv20_rank > 0.2 AND amount_rank > 0.2 AND downside_rank <= 0.95 AND range_position_20 >= 0.08 AND abs(return_1d) <= 0.35", _PRESSURE)

# weekly bars hardly ever pass the gate of the breakout score, so the champion blend stands in for it
_A, _B = "rankic_neg1_downside_range_blend", "smart_money_reversal_value_20"
_BRIDGE = f"""WITH t AS (SELECT asset_id, market, date, {_A} AS a FROM ({SQL["factors_champion"]})), m AS (SELECT asset_id, market, date, {_B} AS b FROM ({SQL["factors_smart_money"]})),
j AS (SELECT * FROM t FULL JOIN m USING (asset_id, market, date)),
r AS (SELECT *, CASE WHEN count(a) OVER ({s.CROSS}) > 1 THEN {s.rank("a")} END AS ra, CASE WHEN count(b) OVER ({s.CROSS}) > 1 THEN {s.rank("b")} END AS rb FROM j)
SELECT asset_id, market, date, round((ra + rb) / 2, 6) AS risk_filter_bridge_equal_20, round(CASE WHEN ra < rb THEN ra WHEN rb <= ra THEN rb END, 6) AS risk_filter_bridge_agreement_20, round(0.65 * ra + 0.35 * rb, 6) AS risk_filter_bridge_anti_obv_weighted_20 FROM r"""


@register("factors_risk_filter_bridge", _BRIDGE)
def factors_risk_filter_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    anti = rounded(c.CHAMPION.compute(valued(spark, sf_dir)), KEYS, [_A])
    smart = rounded(c.SMART_MONEY.compute(valued(spark, sf_dir), (_B,), panel.parts(spark, sf_dir)), KEYS, [_B])
    return rounded(c.risk_filter_bridge(anti, smart, _A, _B, panel.parts(spark, sf_dir)), KEYS, list(c.BRIDGE))


_PARTS = ("value", "stable", "reversal", "calm", "capacity")
_RANKED = lambda e: f"CASE WHEN count({e}) OVER ({s.CROSS}) > 1 THEN {s.rank(e)} END"
_ENSEMBLE = [
    {"ret": C(P), "ret_20": C(P, 20), "amount_20": R("avg", "amount", 20)},
    {"down": "CASE WHEN ret IS NOT NULL THEN least(ret, 0) END", "abs_ret_20": "abs(ret_20)", "vol_20": R("stddev_pop", "ret", 20), "cheap_pe": "-CASE WHEN pe_ttm > 0 THEN ln(pe_ttm) END", "cheap_pb": "-CASE WHEN pb > 0 THEN ln(pb) END", "log_amount": "CASE WHEN amount_20 > 0 THEN ln(amount_20) END"},
    {"down_20": R("stddev_pop", "down", 20)},
    {f"z_{k}": s.z(k) for k in ("cheap_pe", "cheap_pb", "dv_ttm", "down_20", "abs_ret_20", "ret_20", "vol_20", "log_amount", "turnover_rate_f")},
    {"value": "round((z_cheap_pe + z_cheap_pb + z_dv_ttm) / 3, 9)", "stable": "round(-0.65 * z_down_20 - 0.35 * z_abs_ret_20, 9)", "reversal": "round(-z_ret_20, 9)", "calm": "round(-z_vol_20, 9)", "capacity": "round(z_log_amount - 0.25 * z_turnover_rate_f, 9)"},
    {f"r_{k}": _RANKED(k) for k in _PARTS} | {"amount_rank": _RANKED("amount_20")},
    {"l": f"[{', '.join(f'r_{k}' for k in _PARTS)}]"},
    {"present": "list_count(l)", "equal": "list_avg(l)", "spread": "list_stddev_samp(l)", "agree": "len(list_filter(l, lambda x: x > 0.6))"},
    {"valid": "present >= 4 AND amount_rank > 0.25 AND abs(ret) <= 0.5"},
]
_ENSEMBLE_SQL = f"""{s.chain(_ENSEMBLE, start="valued", head=_VALUED)},
mr AS (SELECT market, date, avg(ret) AS r FROM last GROUP BY ALL), mm AS (SELECT market, date, {R("sum", "r", 20, over="PARTITION BY market ORDER BY date")} AS momentum FROM mr)
SELECT asset_id, market, date, round(CASE WHEN valid THEN equal END, 6) AS {c.ENSEMBLE[0]}, round(CASE WHEN valid THEN agree / 5.0 END, 6) AS {c.ENSEMBLE[1]}, round(CASE WHEN valid THEN 1 - spread + 0.05 * equal END, 6) AS {c.ENSEMBLE[2]}, round(CASE WHEN valid AND momentum >= -0.02 THEN equal END, 6) AS {c.ENSEMBLE[3]} FROM last LEFT JOIN mm USING (market, date)"""


@register("factors_anomaly_ensemble", _ENSEMBLE_SQL)
def factors_anomaly_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(c.anomaly_ensemble(valued(spark, sf_dir), panel.parts(spark, sf_dir)), KEYS, list(c.ENSEMBLE))


FLOOR = 60_000.0  # of the order lines; their amounts stay far below the default
_X = f"OVER ({s.CROSS})"
_FLOWED = sorted({x.flow for x in c.COMBOS.values()})
_OUTSIDE = sorted({x for k in c.COMBOS.values() for x in (*k.exposures, k.gate) if x})
_FLOW_EXPR = {f"{n}{end}": f"{sign}({e}) / nullif(total, 0)" for n, e in _MFE.items() for end, sign in (("", ""), ("_low", "-"))}
_HEAD = f"""{s.BARS}, {_MF[len("WITH ") :]},
flowed AS (SELECT asset_id, market, date, {", ".join(f"{_FLOW_EXPR[n]} AS {n}" for n in _FLOWED)} FROM t),
joined AS (SELECT * FROM bars JOIN flowed USING (asset_id, market, date))"""


def _fit(tag: str, y: str, xs: tuple[str, ...]) -> list[dict[str, str]]:
    """Residual by taking each exposure, freed of the ones before, out of the rest."""
    whole = " AND ".join(f"z_{x} IS NOT NULL" for x in (y, *xs))
    cols = {f"{tag}_{i}": f"z_{x}" for i, x in enumerate((y, *xs))}
    stages = [{k: f"CASE WHEN {whole} THEN {e} END" for k, e in cols.items()}, {f"{tag}_n": f"count({tag}_0) {_X}"} | {f"{k}_c": f"{k} - avg({k}) {_X}" for k in cols}]
    now = {k: f"{k}_c" for k in cols}
    for i in range(1, len(cols)):
        b = now[f"{tag}_{i}"]
        rest = [k for k in cols if k == f"{tag}_0" or int(k.rsplit("_", 1)[1]) > i]
        stages.append({f"{now[k]}{i}": f"{now[k]} - sum({now[k]} * {b}) {_X} / (CASE WHEN sum({b} * {b}) {_X} > 1e-9 THEN sum({b} * {b}) {_X} END) * {b}" for k in rest})
        now |= {k: f"{now[k]}{i}" for k in rest}
    return [*stages, {tag: f"CASE WHEN {tag}_n > {len(xs)} THEN {now[f'{tag}_0']} END"}]


def _combo_sql() -> str:
    fits = {k: f"fit{i}" for i, k in enumerate(sorted({(x.flow, x.exposures) for x in c.COMBOS.values() if x.kind == "residual"}))}
    exposures = [
        {"ret": C(P), "momentum_5": C(P, 5), "momentum_10": C(P, 10), "log_amount_20": "CASE WHEN amount > 0 THEN ln(1 + amount) END"},
        {"amihud": "abs(ret) / nullif(amount, 0)", "reversal_5": "-momentum_5", "volatility_10": R("stddev_pop", "ret", 10), "volatility_20": R("stddev_pop", "ret", 20)},
        {"liquidity_10": R("avg", "amihud", 10), "liquidity_20": R("avg", "amihud", 20), "risk_adjusted_momentum_10": "momentum_10 / nullif(volatility_10, 0)"},
    ]
    stages = [*exposures, {f"z_{x}": s.z(x) for x in (*_FLOWED, *_OUTSIDE)}]
    for (y, xs), tag in fits.items():
        stages += _fit(tag, y, xs)
    values = {}
    for n, k in c.COMBOS.items():
        z = f"z_{k.flow}"
        v = {"plus": lambda: f"{z} + z_{k.exposures[0]}", "minus": lambda: f"{z} - z_{k.exposures[0]}", "residual": lambda: fits[k.flow, k.exposures], "keep": lambda: z}[k.kind]()
        when = [f"z_{k.gate} <= median(z_{k.gate}) {_X}"] * bool(k.gate) + [f"amount >= {FLOOR}"] * k.floor
        values[n] = f"CASE WHEN {' AND '.join(when)} THEN {v} END" if when else v
    return s.chain([*stages, values], start="joined", head=_HEAD) + f"\nSELECT asset_id, market, date, {', '.join(f'round({n}, 6) + 0.0 AS {n}' for n in values)} FROM last"


@register("factors_flow_combinations", _combo_sql())
def factors_flow_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(c.flow_combinations(panel.bars(spark, sf_dir), flows(spark, sf_dir), floor=FLOOR), KEYS, list(c.COMBOS))
