"""Selection, trades and portfolios on the panel, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import panel
from ..operators import portfolio, technical
from . import sqltext as s
from .registry import register

_MOM = f"{s.BARS}, f AS (SELECT asset_id, market, industry, date, 'momentum_5' AS factor_name, {s.change('adj_close', 5)} AS factor_value FROM bars), v AS (SELECT * FROM f WHERE factor_value IS NOT NULL)"
_TOP = f"""{_MOM},
r AS (SELECT *, row_number() OVER (PARTITION BY date, market ORDER BY factor_value DESC, asset_id) AS k FROM v),
top AS (SELECT * EXCLUDE k, 1.0 / count(*) OVER (PARTITION BY date, market) AS target_weight FROM r WHERE k <= 3)"""


def momentum(spark: SparkSession, sf_dir: str, more: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """The bars, and momentum in long form with the industry. more: further columns of a bar, to be carried along."""
    bars, more = panel.bars(spark, sf_dir), more or {}
    wide = technical.technical(bars.withColumns(more), 5, ("momentum",), keep=("industry", *more)).where("asset_id is not null and date is not null")
    return bars, technical.long_form(wide, ["momentum"], 5, "_5", ("industry", *more))


@register("select_top", f"WITH {_TOP} SELECT date, market, factor_name, asset_id, round(factor_value, 6) + 0.0 AS factor_value, round(target_weight, 6) AS target_weight FROM top")
def select_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, f = momentum(spark, sf_dir)
    return portfolio.select_top(f, 3).select("date", "market", "factor_name", "asset_id", (F.round("factor_value", 6) + F.lit(0.0)).alias("factor_value"), F.round("target_weight", 6).alias("target_weight"))


@register("select_by_industry", f"""WITH {_MOM}, a AS (SELECT *, row_number() OVER (PARTITION BY date, market, industry ORDER BY factor_value DESC, asset_id) AS turn FROM v),
b AS (SELECT *, row_number() OVER (PARTITION BY date, market ORDER BY turn, factor_value DESC, industry, asset_id) AS k FROM a)
SELECT date, market, factor_name, asset_id, industry, round(1.0 / count(*) OVER (PARTITION BY date, market), 6) AS target_weight FROM b WHERE k <= 5""")
def select_by_industry(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, f = momentum(spark, sf_dir)
    return portfolio.select_top_by_industry(f, 5).select("date", "market", "factor_name", "asset_id", "industry", F.round("target_weight", 6).alias("target_weight"))


@register("exclude_bottom", f"""WITH {_MOM}, r AS (SELECT *, count(*) OVER (PARTITION BY date, market) AS n, row_number() OVER (PARTITION BY date, market ORDER BY factor_value, asset_id) AS k FROM v)
SELECT date, market, factor_name, asset_id, round(1.0 / (n - greatest(1, least(floor(n * 0.2), n - 1))), 6) AS target_weight FROM r WHERE n > 1 AND k > greatest(1, least(floor(n * 0.2), n - 1))""")
def exclude_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, f = momentum(spark, sf_dir)
    return portfolio.exclude_bottom(f, 0.2).select("date", "market", "factor_name", "asset_id", F.round("target_weight", 6).alias("target_weight"))


_A = "PARTITION BY asset_id ORDER BY date"
_TRADES = f"""{_TOP},
m AS (SELECT asset_id, date, row_number() OVER ({_A}) AS no, adj_close AS price, amount AS paid, volume >= 12 AS can_buy, volume >= 20 AS can_sell FROM bars),
m2 AS (SELECT *, min(CASE WHEN can_sell THEN no END) OVER ({_A} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sale_no FROM m),
p AS (SELECT a.asset_id, a.date, e.date AS entry_date, e.price AS entry_price, e.paid, e.can_buy, q.no AS planned_no, x.no AS exit_no, x.date AS exit_date, x.price AS exit_price
      FROM m2 a JOIN m2 e ON e.asset_id = a.asset_id AND e.no = a.no + 1 JOIN m2 q ON q.asset_id = a.asset_id AND q.no = a.no + 3 LEFT JOIN m2 x ON x.asset_id = a.asset_id AND x.no = q.sale_no),
t AS (SELECT top.*, p.* EXCLUDE (asset_id, date), datediff('day', entry_date, exit_date) AS days, CASE WHEN paid > 0 THEN target_weight * 200000.0 / paid END AS part FROM top JOIN p USING (asset_id, date)),
u AS (SELECT *, CASE WHEN NOT can_buy THEN 'entry_not_tradeable' WHEN exit_no IS NULL OR (exit_no > planned_no AND days > 40) THEN 'exit_not_tradeable' WHEN days > 40 THEN 'calendar_limit' WHEN part IS NULL THEN 'amount_missing' WHEN part > 2.0 THEN 'capacity' END AS reject,
  2 * (5.0 + CASE WHEN part > 0 THEN 10.0 * (part / 2.0) ELSE 0 END) / 10000 AS cost_rate, exit_price / entry_price - 1 AS gross FROM t),
trades AS (SELECT *, gross - cost_rate AS net, target_weight * (gross - cost_rate) AS weighted FROM u)"""
_R = lambda c, n=6: f"round({c}, {n}) + 0.0"


def trades_of(spark: SparkSession, sf_dir: str, more: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    bars, f = momentum(spark, sf_dir, more)
    flags = bars.withColumns({"entry_tradeable": F.col("volume") >= 12, "exit_tradeable": F.col("volume") >= 20})
    return bars, portfolio.build_trades(portfolio.select_top(f, 3), flags, lag=1, hold=2, cost_bps=5.0, impact=10.0, limit=2.0, max_days=40, value=200_000.0)


@register("trades", f"WITH {_TRADES} SELECT date AS signal_date, asset_id, market, factor_name, entry_date, coalesce(CAST(exit_date AS VARCHAR), '') AS exit_date, exit_no > planned_no AS delayed, coalesce(reject, '') AS reject, {_R('part')} AS participation_rate, {_R('cost_rate', 8)} AS cost_rate, {_R('gross')} AS gross_return, {_R('net')} AS net_return, {_R('weighted')} AS weighted_return FROM trades")
def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, t = trades_of(spark, sf_dir)
    r = lambda c, n=6: (F.round(c, n) + F.lit(0.0)).alias(c)
    return t.select("signal_date", "asset_id", "market", "factor_name", "entry_date", F.coalesce(F.col("exit_date").cast("string"), F.lit("")).alias("exit_date"), "delayed", F.coalesce("reject", F.lit("")).alias("reject"), r("participation_rate"), r("cost_rate", 8), r("gross_return"), r("net_return"), r("weighted_return"))


@register("trade_rejects", f"WITH {_TRADES} SELECT market, factor_name, coalesce(reject, 'traded') AS outcome, count(*) AS trades FROM trades GROUP BY ALL")
def trade_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.reject_counts(trades_of(spark, sf_dir)[1], ["market", "factor_name"])


_CURVE = f"{_TRADES}, d AS (SELECT market, factor_name, exit_date AS date, sum(weighted) AS r FROM trades WHERE reject IS NULL GROUP BY ALL), curve AS (SELECT *, product(1 + r) OVER (PARTITION BY market, factor_name ORDER BY date ROWS UNBOUNDED PRECEDING) AS e FROM d)"
_METRIC = """c AS (SELECT *, e / max(e) OVER (PARTITION BY {k} ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM curve),
agg AS (SELECT {k}, count(*) AS periods, arg_max(e, date) AS last, avg(r) AS mu, stddev_pop(r) AS sd, min(dd) AS mdd, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS win FROM c GROUP BY ALL)"""
_METRICS = "periods, round(last - 1, 6) + 0.0 AS total_return, round(pow(last, 52.0 / periods) - 1, 6) + 0.0 AS annualized_return, round(sd * sqrt(52.0), 6) AS annualized_volatility, round(coalesce(mu * 52.0 / nullif(sd * sqrt(52.0), 0), 0), 5) + 0.0 AS sharpe, round(mdd, 6) + 0.0 AS max_drawdown, round(win, 6) AS win_rate"


@register("equity_curve", f"WITH {_CURVE} SELECT market, factor_name, date, {_R('r')} AS period_return, {_R('e')} AS equity FROM curve")
def equity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = portfolio.equity(trades_of(spark, sf_dir)[1], ["market", "factor_name"])
    return c.select("market", "factor_name", "date", (F.round("period_return", 6) + F.lit(0.0)).alias("period_return"), (F.round("equity", 6) + F.lit(0.0)).alias("equity"))


def _rounded_metrics(m: DataFrame, keys: list[str]) -> DataFrame:
    return m.select(*keys, "periods", *[(F.round(c, 5 if c == "sharpe" else 6) + F.lit(0.0)).alias(c) for c in ("total_return", "annualized_return", "annualized_volatility", "sharpe", "max_drawdown", "win_rate")])


@register("return_metrics", f"WITH {_CURVE}, {_METRIC.format(k='market, factor_name')} SELECT market, factor_name, {_METRICS} FROM agg")
def return_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["market", "factor_name"]
    return _rounded_metrics(portfolio.return_metrics(portfolio.equity(trades_of(spark, sf_dir)[1], keys), keys, 52.0), keys)


@register("weight_turnover", f"""WITH {_TOP}, st AS (SELECT *, dense_rank() OVER (PARTITION BY market ORDER BY date) AS k FROM top),
cash AS (SELECT market, k, 1 - sum(target_weight) AS c FROM st GROUP BY ALL), mx AS (SELECT market, max(k) AS mk FROM st GROUP BY ALL),
mv AS (SELECT market, k, asset_id, target_weight AS d FROM st UNION ALL SELECT st.market, k + 1, asset_id, -target_weight FROM st JOIN mx USING (market) WHERE k < mk),
a AS (SELECT market, k, sum(d) AS d FROM (SELECT market, k, asset_id, abs(sum(d)) AS d FROM mv GROUP BY ALL) GROUP BY ALL),
b AS (SELECT market, k, abs(c - coalesce(lag(c) OVER (PARTITION BY market ORDER BY k), 1)) AS cm FROM cash)
SELECT market, 'momentum_5' AS factor_name, round(avg(0.5 * (d + cm)), 6) AS turnover FROM a JOIN b USING (market, k) GROUP BY ALL""")
def weight_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, f = momentum(spark, sf_dir)
    t = portfolio.weight_turnover(portfolio.select_top(f, 3).withColumnRenamed("date", "signal_date"), ["market", "factor_name"])
    return t.withColumn("turnover", F.round("turnover", 6))


@register("cap_weights", f"""WITH {_MOM}, r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY factor_value DESC, asset_id) AS k FROM v),
a AS (SELECT *, least(1.0 / count(*) OVER (PARTITION BY date), 0.15) AS w0 FROM r WHERE k <= 6), b AS (SELECT *, CASE WHEN sum(w0) OVER (PARTITION BY date, market) > 0.3 THEN w0 * 0.3 / sum(w0) OVER (PARTITION BY date, market) ELSE w0 END AS w1 FROM a),
c AS (SELECT *, CASE WHEN sum(w1) OVER (PARTITION BY date) > 0.8 THEN w1 * 0.8 / sum(w1) OVER (PARTITION BY date) ELSE w1 END AS w2 FROM b)
SELECT date, market, asset_id, round(w2, 6) AS target_weight, round(greatest(0, 1 - sum(w2) OVER (PARTITION BY date)), 6) AS cash_weight FROM c""")
def cap_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, f = momentum(spark, sf_dir)
    t = portfolio.cap_weights(portfolio.select_top(f, 6, ("date", "factor_name")), ["date"], asset=0.15, market=0.3, gross=0.9, cash=0.2)
    return t.select("date", "market", "asset_id", F.round("target_weight", 6).alias("target_weight"), F.round("cash_weight", 6).alias("cash_weight"))


@register("rebalance_deltas", f"""WITH {_TOP}, st AS (SELECT *, dense_rank() OVER (PARTITION BY market ORDER BY date) AS k FROM top), mx AS (SELECT market, max(k) AS mk FROM st GROUP BY ALL),
t AS (SELECT market, k, asset_id, target_weight AS w FROM st), h AS (SELECT st.market, k + 1 AS k, asset_id, target_weight AS w FROM st JOIN mx USING (market) WHERE k < mk)
SELECT market, CAST(k AS INTEGER) AS step, asset_id, round(coalesce(t.w, 0), 6) AS target_weight, round(coalesce(h.w, 0), 6) AS held_weight,
  CASE WHEN coalesce(t.w, 0) - coalesce(h.w, 0) > 1e-12 THEN 'buy' WHEN coalesce(t.w, 0) - coalesce(h.w, 0) < -1e-12 THEN 'sell' ELSE 'hold' END AS action FROM t FULL JOIN h USING (market, k, asset_id)""")
def rebalance_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    _, f = momentum(spark, sf_dir)
    st = portfolio.select_top(f, 3).withColumn("step", F.dense_rank().over(Window.partitionBy("market").orderBy("date")))
    last = st.groupBy("market").agg(F.max("step").alias("last"))
    held = st.join(last, "market").where("step < last").select("market", (F.col("step") + 1).alias("step"), "asset_id", F.col("target_weight").alias("held_weight"))
    d = portfolio.rebalance_deltas(st, held, ["market", "step", "asset_id"])
    return d.select("market", "step", "asset_id", F.round("target_weight", 6).alias("target_weight"), F.round("held_weight", 6).alias("held_weight"), "action")


_BENCH = f"{s.BARS}, r AS (SELECT *, {s.change('adj_close')} AS r FROM bars), b AS (SELECT market, date, coalesce(avg(r), 0) AS r FROM r GROUP BY ALL)"


@register("benchmark_curve", f"WITH {_BENCH} SELECT market, date, {_R('r')} AS period_return, round(ln(product(1 + r) OVER (PARTITION BY market ORDER BY date ROWS UNBOUNDED PRECEDING)), 6) + 0.0 AS log_equity FROM b")
def benchmark_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = portfolio.benchmark_curve(panel.bars(spark, sf_dir))
    return c.select("market", "date", (F.round("period_return", 6) + F.lit(0.0)).alias("period_return"), (F.round(F.log("equity"), 6) + F.lit(0.0)).alias("log_equity"))


@register("market_beta", f"""WITH {_TRADES}, d AS (SELECT market, exit_date AS date, sum(weighted) AS y FROM trades WHERE reject IS NULL GROUP BY ALL), rr AS (SELECT *, {s.change('adj_close')} AS r0 FROM bars),
bb AS (SELECT market, date, coalesce(avg(r0), 0) AS x FROM rr GROUP BY ALL)
SELECT market, round(regr_slope(y, x), 6) + 0.0 AS beta, round(regr_intercept(y, x), 6) + 0.0 AS alpha, round(regr_r2(y, x), 6) + 0.0 AS r2, count(*) AS n FROM d JOIN bb USING (market, date) GROUP BY market""")
def market_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, t = trades_of(spark, sf_dir)
    b = portfolio.market_beta(portfolio.equity(t, ["market"]), portfolio.benchmark_curve(bars), ["market"], ["market", "date"])
    return b.select("market", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("beta", "alpha", "r2")], "n")


@register("concentration", f"WITH {_TOP}, p AS (SELECT date, market, coalesce(industry, 'UNKNOWN') AS part, sum(target_weight) AS w FROM top GROUP BY ALL), q AS (SELECT *, w / sum(w) OVER (PARTITION BY date, market) AS sh FROM p) SELECT date, market, round(sum(sh * sh), 6) AS hhi, round(max(sh), 6) AS top_share, count(*) AS parts FROM q GROUP BY ALL")
def concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, f = momentum(spark, sf_dir)
    c = portfolio.concentration(portfolio.select_top(f, 3), ["date", "market"], "industry")
    return c.select("date", "market", F.round("hhi", 6).alias("hhi"), F.round("top_share", 6).alias("top_share"), "parts")


#: Case grid: factor x top n x cost x rebalance interval, all evaluated in one job.
GRID = [(n, cost, k) for n in (2, 4) for cost in (0.0, 10.0) for k in (1, 4)]
_GRID = ", ".join(f"({i}, {n}, {c}, {k})" for i, (n, c, k) in enumerate(GRID))


@register("parameter_grid", f"""WITH {s.BARS}, f AS (SELECT asset_id, market, date, 'momentum_5' AS factor_name, {s.change('adj_close', 5)} AS v FROM bars UNION ALL SELECT asset_id, market, date, 'reversal_5', -{s.change('adj_close', 5)} FROM bars),
g(case_no, top_n, cost, every) AS (VALUES {_GRID}),
x AS (SELECT f.*, case_no, top_n, cost, every, dense_rank() OVER (PARTITION BY market, factor_name, case_no ORDER BY date) - 1 AS place FROM f, g WHERE v IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY date, market, factor_name, case_no ORDER BY v DESC, asset_id) AS k FROM x WHERE place % every = 0),
t AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY date, market, factor_name, case_no) AS w FROM r WHERE k <= top_n),
p AS (SELECT asset_id, date, lead(adj_close, 1) OVER ({_A}) AS e, lead(adj_close, 2) OVER ({_A}) AS xx, lead(date, 2) OVER ({_A}) AS xd FROM bars),
curve0 AS (SELECT market, factor_name, case_no, xd AS date, sum(w * (xx / e - 1 - 2 * cost / 10000)) AS r FROM t JOIN p USING (asset_id, date) WHERE xd IS NOT NULL GROUP BY ALL),
curve AS (SELECT *, product(1 + r) OVER (PARTITION BY market, factor_name, case_no ORDER BY date ROWS UNBOUNDED PRECEDING) AS e FROM curve0), {_METRIC.format(k='market, factor_name, case_no')},
z AS (SELECT *, mu * 52.0 / nullif(sd * sqrt(52.0), 0) AS sh FROM agg)
SELECT market, factor_name, case_no, periods, round(sh, 5) + 0.0 AS sharpe, round(mdd, 6) + 0.0 AS max_drawdown, row_number() OVER (PARTITION BY market ORDER BY round(sh, 8) DESC, factor_name, case_no) AS place FROM z""")
def parameter_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    bars = panel.bars(spark, sf_dir)
    wide = technical.technical(bars, 5, ("momentum", "reversal"))
    f = technical.long_form(wide, ["momentum", "reversal"], 5, "_5").where("factor_value is not null")
    cases = [{"case_no": i, "top_n": n, "cost": c, "every": k} for i, (n, c, k) in enumerate(GRID)]
    keys = ["market", "factor_name", "case_no"]
    t = portfolio.build_trades(portfolio.select_grid(f, cases), bars, lag=1, hold=1, cost_bps=F.col("cost"))
    m = portfolio.return_metrics(portfolio.equity(t, keys), keys, 52.0)
    board = m.withColumn("place", F.row_number().over(Window.partitionBy("market").orderBy(F.round("sharpe", 8).desc(), "factor_name", "case_no")))
    return board.select(*keys, "periods", (F.round("sharpe", 5) + F.lit(0.0)).alias("sharpe"), (F.round("max_drawdown", 6) + F.lit(0.0)).alias("max_drawdown"), "place")
