"""Breakdowns, regimes, purged folds and screen features, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import panel
from ..operators import evaluate, labels, portfolio, reports, technical
from . import core_queries
from . import sqltext as s
from .portfolio_queries import _BENCH, _CURVE, _TRADES, trades_of
from .registry import register, rounded
from .research_queries import _CASES, case_curves

KEYS = ["asset_id", "market", "date"]


@register("trade_contributions", f"WITH {_TRADES}, g AS (SELECT market, industry, sum(weighted) AS c, count(*) AS n FROM trades WHERE reject IS NULL GROUP BY ALL) SELECT market, industry, round(c, 6) + 0.0 AS contribution, n AS trades FROM g")
def trade_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.contributions(trades_of(spark, sf_dir)[1], ["market"], ["industry"]).select("market", "industry", (F.round("contribution", 6) + F.lit(0.0)).alias("contribution"), "trades")


@register("trade_quantiles", f"WITH {_TRADES} SELECT market, round(min(net), 6) + 0.0 AS lowest, round(quantile_cont(net, 0.01), 6) + 0.0 AS q01, round(quantile_cont(net, 0.5), 6) + 0.0 AS q50, round(quantile_cont(net, 0.99), 6) + 0.0 AS q99, round(max(net), 6) + 0.0 AS highest, count(*) AS trades FROM trades WHERE reject IS NULL GROUP BY market")
def trade_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = reports.trade_quantiles(trades_of(spark, sf_dir)[1], ["market"], "net_return")
    return q.select("market", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("lowest", "q01", "q50", "q99", "highest")], "trades")


@register("capacity_stress", f"WITH {_TRADES} SELECT market, m AS multiplier, round(avg(CASE WHEN part * m > 2.0 THEN 1.0 ELSE 0.0 END), 6) AS breach_rate, round(max(part * m), 6) AS top_participation, count(*) AS trades FROM (SELECT *, unnest([1.0, 2.0, 5.0]::DOUBLE[]) AS m FROM trades WHERE reject IS NULL AND part IS NOT NULL) GROUP BY ALL")
def capacity_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = reports.capacity_stress(trades_of(spark, sf_dir)[1], ["market"], (1.0, 2.0, 5.0), 2.0)
    return c.select("market", "multiplier", F.round("breach_rate", 6).alias("breach_rate"), F.round("top_participation", 6).alias("top_participation"), "trades")


@register("return_blocks", f"WITH {_CURVE}, y AS (SELECT market, CAST(year(date) AS INTEGER) AS year, product(1 + r) AS g, count(*) AS periods FROM curve GROUP BY ALL) SELECT market, year, periods, round(g - 1, 6) + 0.0 AS year_return, round(product(g) OVER (PARTITION BY market) / g - 1, 6) + 0.0 AS return_without_year FROM y")
def return_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = reports.return_blocks(portfolio.equity(trades_of(spark, sf_dir)[1], ["market"]), ["market"])
    return b.select("market", "year", "periods", (F.round("year_return", 6) + F.lit(0.0)).alias("year_return"), (F.round("return_without_year", 6) + F.lit(0.0)).alias("return_without_year"))


@register("regimes", f"WITH {_BENCH}, e AS (SELECT *, product(1 + r) OVER (PARTITION BY market ORDER BY date ROWS UNBOUNDED PRECEDING) AS q FROM b), m AS (SELECT *, q / nullif(lag(q, 8) OVER (PARTITION BY market ORDER BY date), 0) - 1 AS mom FROM e) SELECT market, CASE WHEN mom > 0.05 THEN 'bull' WHEN mom < -0.05 THEN 'bear' ELSE 'sideways' END AS regime, count(*) AS dates FROM m WHERE mom IS NOT NULL GROUP BY ALL")
def regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports.regimes(portfolio.benchmark_curve(panel.bars(spark, sf_dir)), ["market"], 8, 0.05)
    return r.groupBy("market", "regime").agg(F.count(F.lit(1)).alias("dates"))


_NI = "date, market, industry"


@register("neutral_ic", f"""WITH {s.BARS}, {core_queries._LABELS}, f AS (SELECT asset_id, market, industry, date, {s.change('adj_close', 5)} AS v FROM bars), j AS (SELECT f.*, forward_return AS fr FROM f JOIN labels USING (asset_id, date) WHERE horizon = 1 AND v IS NOT NULL),
b AS (SELECT *, count(*) OVER (PARTITION BY {_NI}) AS n FROM j), r AS (SELECT *, {s.rank('v', _NI)} AS a, {s.rank('fr', _NI)} AS c FROM b WHERE n >= 3)
SELECT date, market, round(CASE WHEN min(a) < max(a) AND min(c) < max(c) THEN corr(a, c) END, 6) + 0.0 AS neutral_rank_ic, count(*) AS assets, count(DISTINCT industry) AS industries FROM r GROUP BY date, market HAVING count(DISTINCT industry) >= 2""")
def neutral_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = panel.bars(spark, sf_dir)
    f = technical.technical(bars, 5, ("momentum",)).withColumnRenamed("momentum", "factor_value").join(bars.select("asset_id", "date", "industry"), ["asset_id", "date"])
    rows = f.join(labels.forward_returns(bars, (1,)).select("asset_id", "date", "forward_return"), ["asset_id", "date"])
    out = reports.neutral_ic(rows, ("date", "market"))
    return out.select("date", "market", (F.round("neutral_rank_ic", 6) + F.lit(0.0)).alias("neutral_rank_ic"), "assets", "industries")


@register("purged_folds", f"""WITH {_CASES}, n AS (SELECT market, date, row_number() OVER (PARTITION BY market ORDER BY date) AS i, count(*) OVER (PARTITION BY market) AS c FROM (SELECT DISTINCT market, date FROM ls)), g AS (SELECT *, CAST(floor((i - 1) * 5 / CAST(c AS DOUBLE)) AS INTEGER) AS g FROM n),
sp AS (SELECT market, g, min(i) AS a, max(i) AS z FROM g GROUP BY ALL)
SELECT g.market, CAST(x.g * 5 + y.g AS INTEGER) AS split, g.date, CASE WHEN g.g = x.g OR g.g = y.g THEN 'test' WHEN i BETWEEN x.a - 3 AND x.z + 3 OR i BETWEEN y.a - 3 AND y.z + 3 THEN 'purged' ELSE 'train' END AS role FROM g JOIN sp x ON x.market = g.market JOIN sp y ON y.market = g.market AND x.g < y.g""")
def purged_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.purged_folds(case_curves(spark, sf_dir), ["market"], 5, 2, 3)


@register("probabilistic_sharpe")
def probabilistic_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.probabilistic_sharpe(case_curves(spark, sf_dir), ["market", "case_no"])


@register("net_of_cost", f"""WITH {core_queries._GROUPS}, ls AS (SELECT a.market, a.factor_name, a.date, a.m - b.m AS r FROM groups a JOIN groups b USING (date, market, factor_name, horizon, execution_lag) WHERE a.quantile = 5 AND b.quantile = 1 AND horizon = 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY date, market, factor_name ORDER BY factor_value, asset_id) AS i, count(*) OVER (PARTITION BY date, market, factor_name) AS n FROM factors WHERE factor_value IS NOT NULL),
t AS (SELECT date, market, factor_name, asset_id FROM rk WHERE n > 1 AND greatest(0, CAST(ceil((i - 1) * 5.0 / (n - 1)) AS INTEGER) - 1) = 4),
d AS (SELECT *, dense_rank() OVER (PARTITION BY market, factor_name ORDER BY date) AS k FROM t), c AS (SELECT market, factor_name, k, date, count(*) AS n FROM d GROUP BY ALL),
o AS (SELECT a.market, a.factor_name, a.k, count(*) AS n FROM d a JOIN d b ON a.market = b.market AND a.factor_name = b.factor_name AND a.asset_id = b.asset_id AND a.k = b.k + 1 GROUP BY ALL),
tv AS (SELECT a.date, a.market, a.factor_name, 1 - coalesce(o.n, 0) / greatest(a.n, b.n) AS tv FROM c a JOIN c b ON a.market = b.market AND a.factor_name = b.factor_name AND a.k = b.k + 1 LEFT JOIN o ON o.market = a.market AND o.factor_name = a.factor_name AND o.k = a.k)
SELECT ls.market, ls.factor_name, ls.date, cost, round(r - cost * coalesce(tv, 1.0), 6) + 0.0 AS net_return FROM ls LEFT JOIN tv USING (market, factor_name, date), (SELECT unnest([0.0, 0.001]::DOUBLE[]) AS cost)""")
def net_of_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    factors, returns = core_queries.study(spark, sf_dir)
    spread = evaluate.long_short(evaluate.quantile_returns(factors, returns)).where("horizon = 1")
    out = reports.net_of_cost(spread, evaluate.top_set_turnover(factors), ["market", "factor_name"], (0.0, 0.001))
    return out.select("market", "factor_name", "date", "cost", (F.round("net_return", 6) + F.lit(0.0)).alias("net_return"))


_decay = [f"lag(ret, {k}) OVER ({s.ASSET})" if k else "ret" for k in range(10)]
_SCREEN = [
    {"ret": s.change("adj_close"), "overnight": f"open / {s.lag('adj_close')} - 1", "intraday": "adj_close / open - 1", "prior_high": s.roll("max", "high", 52, shift=1), "year_high": s.roll("max", "high", 52), "shadow": "(high - greatest(adj_close, open)) / high"},
    {"close_position": "(adj_close - low) / nullif(high - low, 0)", "gap_fade": "-overnight", "decayed_return_10": "(" + " + ".join(f"coalesce({10 - k} * {e}, 0)" for k, e in enumerate(_decay)) + ") / nullif(" + " + ".join(f"CASE WHEN {e} IS NOT NULL THEN {10 - k} ELSE 0 END" for k, e in enumerate(_decay)) + ", 0)", "high_52week": "adj_close / year_high", "breakout_52week": "adj_close / prior_high - 1", "overnight_20": s.roll("avg", "overnight", 20), "intraday_20": s.roll("avg", "intraday", 20), "max_return_20": s.roll("max", "ret", 20), "upper_shadow_20": s.roll("avg", "shadow", 20)},
]


@register("screen_features", s.final(_SCREEN, list(reports.SCREEN)))
def screen_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.screen_features(panel.bars(spark, sf_dir)), KEYS, list(reports.SCREEN))
