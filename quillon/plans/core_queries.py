"""Panel, technical factors, labels and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import panel
from ..operators import evaluate, labels, technical
from . import sqltext as s
from .registry import register, rounded

KEYS = ["asset_id", "market", "date"]


@register("panel_bars", f"WITH {s.BARS} SELECT asset_id, market, industry, date, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(adj_close, 8) AS adj_close, round(volume, 2) AS volume, round(amount, 2) AS amount FROM bars")
def panel_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = panel.bars(spark, sf_dir)
    r = lambda c, n: F.round(c, n).alias(c)
    return b.select("asset_id", "market", "industry", "date", r("open", 8), r("high", 8), r("low", 8), r("adj_close", 8), r("volume", 2), r("amount", 2))


def technical_stages(n: int) -> list[dict[str, str]]:
    half, short = max(1, n // 2), max(2, n // 3)
    among = lambda need, e: f"(CASE WHEN {' AND '.join(f'{c} IS NOT NULL' for c in need)} THEN {e} END)"
    parts = ["momentum", "market_relative_strength", "drawdown_resilience", "low_downside_volatility", "liquidity_resilience", "crash_recovery", "recovery_quality"]
    gate = lambda g: f"CASE WHEN {s.rank(among([g, 'average_amount', 'liquidity_resilience'], 'average_amount'))} > 0.5 AND {s.rank(among([g, 'average_amount', 'liquidity_resilience'], 'liquidity_resilience'))} > 0.5 THEN {g} END"
    comp = lambda cs: "(" + " + ".join(s.rank(among(cs, c)) for c in cs) + f") / {len(cs)}"
    x = "OVER (PARTITION BY date, market)"
    return [
        {"ret": s.change("adj_close"), "paid": "nullif(amount, 0)", "momentum": s.change("adj_close", n), "mom_half": s.change("adj_close", half), "mom_short": s.change("adj_close", short), "high_n": s.roll("max", "adj_close", n), "volume_change": f"volume / nullif({s.roll('avg', 'volume', n)}, 0) - 1"},
        {"down": "CASE WHEN ret IS NOT NULL THEN least(ret, 0) END", "amihud": "abs(ret) / paid", "paid_change": s.change("paid"), "recent": s.roll("avg", "paid", half), "drawdown_resilience": "adj_close / nullif(high_n, 0) - 1", "volatility": s.roll("stddev_pop", "ret", n), "positive": "CASE WHEN amount > 0 THEN amount END"},
        {"liquidity": s.roll("avg", "amihud", n), "amount_stability": "-" + s.roll("stddev_pop", "paid_change", n), "average_amount": f"ln(1 + {s.roll('avg', 'positive', n)})", "acceleration": f"ln(recent / {s.lag('recent', half)})", "down_sd": s.roll("stddev_pop", "down", n)},
        {"reversal": "-momentum", "risk_adjusted_momentum": "momentum / nullif(volatility, 0)", "low_volatility": "-volatility", "low_downside_volatility": "-down_sd", "high_liquidity": "-liquidity", "liquidity_resilience": "-amihud", "crash_recovery": "mom_short * -least(drawdown_resilience, CASE WHEN drawdown_resilience IS NOT NULL THEN 0 END)", "recovery_quality": "mom_short / nullif(down_sd, 0) + drawdown_resilience", "demand_pressure": "mom_half * acceleration", "quiet_accumulation": "acceleration - volatility"},
        {"market_relative_strength": f"momentum - median(momentum) {x}"},
        {"momentum_dispersion_breakout": f"market_relative_strength / nullif(stddev_pop(momentum) {x}, 0)"},
        {f"liquid_{g}": gate(g) for g in ("market_relative_strength", "crash_recovery", "recovery_quality", "demand_pressure", "quiet_accumulation")} | {f"r_{c}": s.rank(among(parts, c)) for c in parts} | {"m_momentum": f"median({among(parts, 'momentum')}) {x}", "m_drawdown": f"median({among(parts, 'drawdown_resilience')}) {x}"},
        {"trend": "(r_momentum + r_market_relative_strength) / 2", "defense": "(r_drawdown_resilience + r_low_downside_volatility + r_liquidity_resilience) / 3", "recovery": "(r_crash_recovery + r_recovery_quality + r_drawdown_resilience) / 3"},
        {"state_adaptive_trend_defense": "CASE WHEN m_momentum >= 0 THEN trend ELSE defense END", "state_stress_defensive_resilience": "CASE WHEN m_momentum < 0 OR m_drawdown < -0.05 THEN defense END", "state_stress_recovery_leadership": "CASE WHEN m_momentum < 0 OR m_drawdown < -0.05 THEN recovery END",
         "trend_resilience": comp(["momentum", "drawdown_resilience", "liquidity_resilience"]), "risk_confirmed_momentum": comp(["risk_adjusted_momentum", "drawdown_resilience", "amount_stability"]), "defensive_reversal": comp(["reversal", "low_downside_volatility", "liquidity_resilience"]), "liquidity_confirmed_breakout": comp(["momentum", "amount_stability", "liquidity_resilience"])},
    ]


def _technical(n: int):
    names = list(technical.NAMES)
    tiny = {"liquidity", "high_liquidity", "liquidity_resilience"}  # of the order of 1e-6: scaled before rounding
    sql = s.chain(technical_stages(n)) + f"\nSELECT asset_id, market, date, {', '.join(f'round({c} * 1000000, 4) + 0.0 AS {c}' if c in tiny else f'round({c}, 6) + 0.0 AS {c}' for c in names)} FROM last"

    @register(f"factors_technical_{n}", sql)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        wide = technical.technical(panel.bars(spark, sf_dir), n, parts=panel.parts(spark, sf_dir))
        return wide.select(*KEYS, *[((F.round(F.col(c) * 1e6, 4) if c in tiny else F.round(c, 6)) + F.lit(0.0)).alias(c) for c in names])

    return query


for _n in (5, 20):
    _technical(_n)


_LABELS = """labels AS (
SELECT date, asset_id, market, h AS horizon, 1 AS execution_lag, x / nullif(e, 0) - 1 AS forward_return, e_date AS entry_date, x_date AS exit_date
FROM (SELECT date, asset_id, market, h, lead(adj_close, 1) OVER w AS e, lead(date, 1) OVER w AS e_date, lead(adj_close, 1 + h) OVER w AS x, lead(date, 1 + h) OVER w AS x_date
      FROM bars, (SELECT unnest([1, 5, 20]) AS h) WINDOW w AS (PARTITION BY asset_id, h ORDER BY date))
WHERE x IS NOT NULL AND e_date IS NOT NULL AND x_date IS NOT NULL)"""


@register("forward_returns", f"WITH {s.BARS}, {_LABELS} SELECT date, asset_id, market, horizon, execution_lag, round(forward_return, 6) AS forward_return, entry_date, exit_date FROM labels")
def forward_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = labels.forward_returns(panel.bars(spark, sf_dir))
    return found.withColumn("forward_return", F.round("forward_return", 6))


@register("forward_returns_aligned", f"""WITH {s.BARS}, {_LABELS},
days AS (SELECT market, date, row_number() OVER (PARTITION BY market ORDER BY date) AS n FROM (SELECT DISTINCT market, date FROM bars))
SELECT l.date, l.asset_id, l.market, horizon, execution_lag, round(forward_return, 6) AS forward_return, entry_date, exit_date
FROM labels l JOIN days a ON a.market = l.market AND a.date = l.date JOIN days b ON b.market = l.market AND b.date = l.entry_date JOIN days c ON c.market = l.market AND c.date = l.exit_date
WHERE b.n = a.n + 1 AND c.n = b.n + horizon""")
def forward_returns_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = panel.bars(spark, sf_dir)
    return labels.aligned_labels(labels.forward_returns(b), b).withColumn("forward_return", F.round("forward_return", 6))


#: A factor in long form and the one-bar labels, as the evaluation queries use them.
_STUDY = f"""{s.BARS}, {_LABELS},
factors AS (SELECT date, asset_id, market, 'momentum_5' AS factor_name, {s.change('adj_close', 5)} AS factor_value FROM bars
            UNION ALL SELECT date, asset_id, market, 'volume_change_5', volume / nullif({s.roll('avg', 'volume', 5)}, 0) - 1 FROM bars),
merged AS (SELECT f.*, horizon, execution_lag, forward_return FROM factors f JOIN labels USING (date, asset_id, market) WHERE factor_value IS NOT NULL AND horizon IN (1, 5))"""
_G = "date, market, factor_name, horizon, execution_lag"
_IC = f"""{_STUDY},
ranked AS (SELECT *, {s.mean_rank('factor_value', _G)} AS fr, {s.mean_rank('forward_return', _G)} AS rr FROM merged),
ic0 AS (SELECT {_G}, count(*) AS n, CASE WHEN min(factor_value) < max(factor_value) AND min(forward_return) < max(forward_return) THEN corr(factor_value, forward_return) END AS ic,
        CASE WHEN min(fr) < max(fr) AND min(rr) < max(rr) THEN corr(fr, rr) END AS rank_ic FROM ranked GROUP BY ALL)"""


def study(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = panel.bars(spark, sf_dir)
    wide = technical.technical(b, 5, ("momentum", "volume_change"))
    return technical.long_form(wide, ["momentum", "volume_change"], 5, "_5"), labels.forward_returns(b, (1, 5))


def study_rows(spark: SparkSession, sf_dir: str, more: dict[str, Column] | None = None) -> tuple[DataFrame, list[str]]:
    """evaluate.merged() of study(), without its join. more: further columns of a bar."""
    more = more or {}
    b = panel.bars(spark, sf_dir).withColumns(more)
    wide = technical.technical(b, 5, ("momentum", "volume_change"), keep=("adj_close", *more))
    rows = labels.labelled(wide, ["momentum", "volume_change"], (1, 5), suffix="_5", keep=tuple(more), parts=panel.parts(spark, sf_dir))
    return rows, ["date", "market", "factor_name", "horizon", "execution_lag"]


_t = lambda c: f"CASE WHEN n >= 3 AND {c} IS NOT NULL THEN round(CASE WHEN abs({c}) >= 1 - 1e-12 THEN NULL ELSE {c} * sqrt((n - 2) / (1 - {c} * {c})) END, 5) + 0.0 END"


@register("ic_daily", f"WITH {_IC} SELECT {_G}, n AS count, round(ic, 6) + 0.0 AS ic, round(rank_ic, 6) + 0.0 AS rank_ic, {_t('ic')} AS ic_t_stat, {_t('rank_ic')} AS rank_ic_t_stat FROM ic0")
def ic_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    ic = evaluate.correlations(*study_rows(spark, sf_dir), p_values=False)
    # a perfect correlation is 1 only up to rounding: its statistic is not compared
    t = lambda c: F.when(F.abs(c) < 1 - 1e-12, F.round(f"{c}_t_stat", 5) + F.lit(0.0)).alias(f"{c}_t_stat")
    return ic.select("date", "market", "factor_name", "horizon", "execution_lag", "count", (F.round("ic", 6) + F.lit(0.0)).alias("ic"), (F.round("rank_ic", 6) + F.lit(0.0)).alias("rank_ic"), t("ic"), t("rank_ic"))


@register("ic_p_values")
def ic_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.correlations(*study_rows(spark, sf_dir))


_GROUPS = f"""{_STUDY},
placed AS (SELECT *, least(5, greatest(1, CAST(ceil(row_number() OVER (PARTITION BY {_G} ORDER BY factor_value, asset_id) * 5.0 / count(*) OVER (PARTITION BY {_G})) AS INTEGER))) AS quantile FROM merged),
groups AS (SELECT {_G}, quantile, avg(forward_return) AS m, count(*) AS n FROM placed GROUP BY ALL)"""


@register("quantile_returns", f"WITH {_GROUPS} SELECT {_G}, quantile, round(m, 6) AS mean_forward_return, n AS count FROM groups")
def quantile_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.bucket_returns(*study_rows(spark, sf_dir)).withColumn("mean_forward_return", F.round("mean_forward_return", 6))


@register("long_short", f"WITH {_GROUPS} SELECT a.date, a.market, a.factor_name, a.horizon, a.execution_lag, round(a.m - b.m, 6) AS long_short_return FROM groups a JOIN groups b USING (date, market, factor_name, horizon, execution_lag) WHERE a.quantile = 5 AND b.quantile = 1")
def long_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.long_short(evaluate.bucket_returns(*study_rows(spark, sf_dir))).withColumn("long_short_return", F.round("long_short_return", 6))


_K = "market, factor_name, horizon, execution_lag"


@register("ic_summary", f"""WITH {_IC}, v AS (SELECT * FROM ic0 WHERE rank_ic IS NOT NULL),
b AS (SELECT {_K}, avg(rank_ic) AS mu, stddev_pop(rank_ic) AS sd, avg(CASE WHEN round(rank_ic, 12) > 0 THEN 1.0 ELSE 0.0 END) AS pos, count(*) AS n FROM v GROUP BY ALL),
l AS (SELECT *, least(n - 1, greatest(1, CAST(floor(4 * pow(n / 100.0, 2.0 / 9.0)) AS INTEGER))) AS max_lag FROM b),
c AS (SELECT v.{', v.'.join(_K.split(', '))}, v.date, v.rank_ic - l.mu AS d, l.max_lag, row_number() OVER (PARTITION BY {', '.join('v.' + k for k in _K.split(', '))} ORDER BY v.date) AS i FROM v JOIN l USING ({_K})),
g AS (SELECT a.market, a.factor_name, a.horizon, a.execution_lag, sum(CASE WHEN a.i = b.i THEN a.d * b.d ELSE 2 * (1 - (a.i - b.i) / (a.max_lag + 1.0)) * a.d * b.d END) AS g
      FROM c a JOIN c b USING ({_K}) WHERE b.i <= a.i AND a.i - b.i <= a.max_lag GROUP BY ALL)
SELECT market, factor_name, horizon, execution_lag, n, max_lag, round(mu, 6) AS mean_ic, round(mu / sd, 6) AS icir, round(pos, 6) AS positive_rate, round(mu / sqrt(greatest(g / (n - 1), 0) / n), 5) AS nw_t_stat
FROM l JOIN g USING ({_K})""")
def ic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.ic_summary(evaluate.correlations(*study_rows(spark, sf_dir), p_values=False), p_values=False)
    return out.select("market", "factor_name", "horizon", "execution_lag", "n", "max_lag", *[F.round(c, 6).alias(c) for c in ("mean_ic", "icir", "positive_rate")], F.round("nw_t_stat", 5).alias("nw_t_stat"))


@register("top_set_turnover", f"""WITH {_STUDY}, r AS (SELECT *, row_number() OVER (PARTITION BY date, market, factor_name ORDER BY factor_value, asset_id) AS i, count(*) OVER (PARTITION BY date, market, factor_name) AS n FROM factors WHERE factor_value IS NOT NULL),
t AS (SELECT date, market, factor_name, asset_id FROM r WHERE n > 1 AND greatest(0, CAST(ceil((i - 1) * 5.0 / (n - 1)) AS INTEGER) - 1) = 4),
d AS (SELECT *, dense_rank() OVER (PARTITION BY market, factor_name ORDER BY date) AS k FROM t),
c AS (SELECT market, factor_name, k, date, count(*) AS n FROM d GROUP BY ALL),
o AS (SELECT a.market, a.factor_name, a.k, count(*) AS n FROM d a JOIN d b ON a.market = b.market AND a.factor_name = b.factor_name AND a.asset_id = b.asset_id AND a.k = b.k + 1 GROUP BY ALL)
SELECT a.date, a.market, a.factor_name, round(1 - coalesce(o.n, 0) / greatest(a.n, b.n), 6) AS turnover FROM c a JOIN c b ON a.market = b.market AND a.factor_name = b.factor_name AND a.k = b.k + 1 LEFT JOIN o ON o.market = a.market AND o.factor_name = a.factor_name AND o.k = a.k""")
def top_set_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.top_set_turnover(study(spark, sf_dir)[0]).withColumn("turnover", F.round("turnover", 6))


@register("factor_correlation", f"""WITH {_STUDY}, refs AS (SELECT date, asset_id, market, 'average_amount_5' AS reference_name, ln(1 + {s.roll('avg', 'amount', 5)}) AS reference_value FROM bars),
b AS (SELECT * FROM factors JOIN refs USING (date, asset_id, market) WHERE factor_value IS NOT NULL AND reference_value IS NOT NULL),
r AS (SELECT *, {s.mean_rank('factor_value', 'date, market, factor_name, reference_name')} AS a, {s.mean_rank('reference_value', 'date, market, factor_name, reference_name')} AS c FROM b),
d AS (SELECT date, market, factor_name, reference_name, CASE WHEN min(a) < max(a) AND min(c) < max(c) THEN corr(a, c) END AS k FROM r GROUP BY ALL)
SELECT factor_name, reference_name, round(avg(k), 6) AS mean_correlation, count(k) AS n_dates FROM d WHERE k IS NOT NULL GROUP BY ALL""")
def factor_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, _ = study(spark, sf_dir)
    refs = technical.long_form(technical.technical(panel.bars(spark, sf_dir), 5, ("average_amount",)), ["average_amount"], 5, "_5")
    return evaluate.factor_correlation(left, refs, panel.parts(spark, sf_dir)).withColumn("mean_correlation", F.round("mean_correlation", 6))
