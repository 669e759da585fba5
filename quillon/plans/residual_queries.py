"""Residual composites, listing age and residual risk, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import panel
from ..operators import residuals
from . import sqltext as s
from .input_queries import _VALUED, _VF, valued
from .registry import register, rounded

KEYS = ["asset_id", "market", "date"]
X = "OVER (PARTITION BY date, market)"


def _composite(i: int, weights: dict[str, float], exposures: tuple[str, ...]) -> list[dict[str, str]]:
    """Exposures are made orthogonal one after the other; what they explain is taken off in turn."""
    score = " + ".join(f"({v!r}) * " + (f"z_{k}" if k == "dv_ttm" else f"coalesce(z_{k}, 0)") for k, v in weights.items())
    gate = "adv20_rank > 0.2 AND amount_rank > 0.2 AND downside_rank <= 0.85 AND range_position_20 >= 0.1 AND abs(return_1d) <= 0.35 AND " + " AND ".join(f"{x} IS NOT NULL" for x in exposures)
    y, a, b, c = (f"{n}{i}" for n in "yabc")
    on = lambda u, v: f"coalesce(sum({u} * {v}) {X} / nullif(CASE WHEN sum({v} * {v}) {X} > 1e-9 THEN sum({v} * {v}) {X} END, 0), 0) * {v}"
    return [
        {f"sc{i}": f"CASE WHEN {gate} THEN {score} END"},
        {f"n{i}": f"count(sc{i}) {X}", y: s.z(f"sc{i}"), **{f"e{i}_{j}": f"CASE WHEN sc{i} IS NOT NULL THEN coalesce({s.z(f'(CASE WHEN sc{i} IS NOT NULL THEN {x} END)')}, 0) END" for j, x in enumerate(exposures)}},
        {a: f"e{i}_0"},
        {b: f"e{i}_1 - {on(f'e{i}_1', a)}"},
        {c: f"e{i}_2 - {on(f'e{i}_2', a)} - {on(f'e{i}_2', b)}"},
        {f"l{i}": f"{y} - {on(y, a)} - {on(y, b)} - {on(y, c)}"},
        {list(residuals.RESIDUAL_COMPOSITES)[i]: f"CASE WHEN n{i} > 5 AND stddev_pop(l{i}) {X} > 1e-12 THEN l{i} END"},
    ]


_used = sorted({k for t, _ in residuals.RESIDUAL_COMPOSITES.values() for k in t})
_RC = [*_VF, {"log_adv20": "ln(adv20)", "amount_trend_20": "adv5 / nullif(adv20, 0) - 1"}, {f"z_{k}": s.z(k) for k in _used}]
for _i, (_t, _e) in enumerate(residuals.RESIDUAL_COMPOSITES.values()):
    _RC += _composite(_i, _t, _e)


@register("factors_residual_composite", s.chain(_RC, start="valued", head=_VALUED) + f"\nSELECT asset_id, market, date, {', '.join(f'round({n}, 6) + 0.0 AS {n}' for n in residuals.RESIDUAL_COMPOSITES)} FROM last")
def factors_residual_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(residuals.residual_composites(valued(spark, sf_dir), panel.parts(spark, sf_dir)), KEYS, list(residuals.RESIDUAL_COMPOSITES))


_PREFIX = {0: "688", 1: "300", 2: "830", 3: "600"}
_LA = [
    {"days": "CAST(datediff('day', DATE '1994-06-01' + CAST(asset_id * 12 AS INTEGER), date) AS DOUBLE)", "gone": "CASE WHEN asset_id % 9 = 0 THEN DATE '2000-01-01' END"},
    {"ok": "days >= 0 AND (gone IS NULL OR date <= gone)"},
    {"log_age": "CASE WHEN ok THEN ln(1 + days) END", "young": "CASE WHEN ok THEN greatest(0, least(252, 252 - days)) / 252 END", "fresh": "CASE WHEN ok THEN greatest(0, least(120, 120 - days)) / 120 END", "risk": "CASE WHEN ok THEN CASE asset_id % 4 WHEN 2 THEN 1.0 WHEN 3 THEN 0.0 ELSE 0.75 END END"},
    {"mid": "CASE WHEN ok THEN greatest(-1, least(1, 1 - abs(log_age - ln(651)) / (ln(1001) - ln(253)))) END", "main": "CASE WHEN asset_id % 4 = 3 THEN 1 ELSE 0 END - risk"},
    {n: e for n, e in zip(residuals.LISTING_AGE, (s.z("log_age"), "-" + s.z("young"), s.z("mid"), "-" + s.z("fresh"), s.z("main"), "-" + s.z("risk"), f"{s.z('log_age')} - 0.5 * {s.z('risk')}"))},
]


@register("factors_listing_age", s.final(_LA, list(residuals.LISTING_AGE)))
def factors_listing_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("asset_id")
    prefix = F.element_at(F.array(*[F.lit(_PREFIX[i]) for i in range(4)]), (a % 4).cast("int") + 1)
    symbol = F.concat(prefix, F.lpad(a.cast("string"), 3, "0"), F.when(a % 4 == 2, ".BJ").otherwise(".XX"))
    basic = panel.assets(spark, sf_dir).select("asset_id", symbol.alias("symbol"), F.lit("").alias("segment"), F.lit("").alias("exchange"), F.date_add(F.lit("1994-06-01").cast("date"), (a * 12).cast("int")).alias("list_date"), F.when(a % 9 == 0, F.lit("2000-01-01").cast("date")).alias("delist_date"))
    return rounded(residuals.listing_age(panel.bars(spark, sf_dir), basic), KEYS, list(residuals.LISTING_AGE))


def _win(n: int) -> str:
    return f"OVER (PARTITION BY asset_id ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _beta(a: str, b: str, n: int, least: int) -> str:
    w = _win(n)
    return f"CASE WHEN count({a}) {w} >= {least} AND min({a}) {w} < max({a}) {w} AND var_samp({b}) {w} > 1e-12 THEN covar_samp({a}, {b}) {w} / var_samp({b}) {w} END"


@register("factors_residual_risk", s.final([
    {"r": s.change("adj_close")},
    {"k": f"CASE WHEN count(r) {X} >= 8 THEN median(r) {X} END"},
    {"pr": "CASE WHEN k IS NOT NULL THEN r END", "pk": "CASE WHEN r IS NOT NULL THEN k END", "dr": "CASE WHEN k < 0 THEN r END", "dk": "CASE WHEN r IS NOT NULL AND k < 0 THEN k END"},
    {"beta": _beta("pr", "pk", 120, 80), "mr": s.roll("avg", "r", 120, 80), "mk": s.roll("avg", "k", 120, 80), "etf_downside_beta_low_120": f"-({_beta('dr', 'dk', 120, 24)})"},
    {"residual": f"r - lag(mr - beta * mk) OVER ({s.ASSET}) - lag(beta) OVER ({s.ASSET}) * k"},
    {"etf_idio_vol_low_60": "-" + s.roll("stddev_pop", "residual", 60, 40), "etf_positive_residual_skew_60": s.roll("skewness", "residual", 60, 40)},
], list(residuals.RESIDUAL_RISK), digits=5))
def factors_residual_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(residuals.residual_risk(panel.bars(spark, sf_dir), least_assets=8, parts=panel.parts(spark, sf_dir)), KEYS, list(residuals.RESIDUAL_RISK), 5)
