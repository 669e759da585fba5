"""Statement merges, industry and style residuals, overlays and repairs of return series, index events, with their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import panel
from ..functions import windows as w
from ..operators import neutralize, overlays, portfolio, signals, statements
from . import portfolio_queries, research_queries, signal_queries
from . import sqltext as s
from .registry import register, rounded

KEYS = ["asset_id", "market", "date"]
_X = "OVER (PARTITION BY date, market)"
_XI = "OVER (PARTITION BY date, market, industry)"
_NAMES = ("y", "x1", "x2")
_STYLED = (
    s.chain(research_queries._EXPOSED)
    + f""",
f AS (SELECT *, count(*) {_X} AS n, {', '.join(f"coalesce({s.z(c)}, 0) AS z{c}" for c in _NAMES)} FROM last WHERE {research_queries._FULL} AND industry IS NOT NULL),
k AS (SELECT date, market, count(DISTINCT industry) AS industries FROM f GROUP BY ALL),
d AS (SELECT *, {', '.join(f"z{c} - avg(z{c}) {_XI} AS d{c}" for c in _NAMES)} FROM f),
m AS (SELECT *, sum(dx1 * dx1) {_X} AS s11, sum(dx2 * dx2) {_X} AS s22, sum(dx1 * dx2) {_X} AS s12, sum(dx1 * dy) {_X} AS s1y, sum(dx2 * dy) {_X} AS s2y FROM d),
r AS (SELECT m.*, CASE WHEN n >= 12 AND industries >= 3 THEN dy - (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) * dx1 - (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) * dx2 END AS e FROM m JOIN k USING (date, market)),
q AS (SELECT asset_id, market, date, CASE WHEN stddev_pop(e) {_X} > 1e-12 THEN e END AS residual FROM r)
SELECT asset_id, market, date, round(residual, 6) + 0.0 AS residual FROM last LEFT JOIN q USING (asset_id, market, date)"""
)


@register("industry_style_residual", _STYLED)
def industry_style_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neutralize.industry_style_residual(research_queries.exposed(spark, sf_dir), "y", ["x1", "x2"], least=12)
    return rounded(out, KEYS, ["residual"])


@register("rolling_mad", s.final([{"r": s.change("adj_close")}, {"mad_20": s.roll("mad", "r", 20, 10), "prior_mad_20": s.roll("mad", "r", 20, 10, shift=1)}], ["mad_20", "prior_mad_20"]))
def rolling_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = panel.bars(spark, sf_dir).withColumn("r", w.change("adj_close"))
    return rounded(b.withColumns({"mad_20": w.mad("r", 20, 10), "prior_mad_20": w.mad("r", 20, 10, shift=1)}), KEYS, ["mad_20", "prior_mad_20"])


# orders as filings of three statements: an order's quarter is the period, some weeks later it is announced
_FILED = """filed AS (SELECT o_orderkey AS version, 'S' || (o_custkey % 40) AS symbol, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS end_date, CAST(CAST(date_trunc('quarter', o_orderdate) AS DATE) + CAST(100 + 7 * (o_orderkey % 12) AS INTEGER) AS DATE) AS ann_date,
  CAST(1 + o_orderkey % 3 AS VARCHAR) AS report_type, CASE WHEN o_custkey % 2 = 0 THEN 'a' END AS comp_type, 'q' AS end_type, o_totalprice AS v, o_orderkey % 5 AS part FROM orders)"""
_SK = ", ".join(statements.STATEMENT_KEYS)


def _one(name: str, parts: str, columns: dict[str, str]) -> str:
    picks = ", ".join(f"arg_max({e}, version) AS {c}" for c, e in columns.items())
    return f"{name} AS (SELECT {_SK}, {picks} FROM filed WHERE part IN ({parts}) GROUP BY ALL)"


_MATCH = lambda a, b: " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in statements.STATEMENT_KEYS)
_KEYED = lambda *t: ", ".join(f"coalesce({', '.join(f'{x}.{k}' for x in t)}) AS {k}" for k in statements.STATEMENT_KEYS)
_MERGED = f"""{_FILED}, {_one('inc', '0, 1, 2', {'netprofit': 'v'})}, {_one('bal', '1, 2, 3', {'total_assets': 'v * 10', 'total_liab': 'v * 4'})}, {_one('csh', '2, 3, 4', {'n_cashflow_act': 'v / 2'})},
ib AS (SELECT {_KEYED('inc', 'bal')}, netprofit, total_assets, total_liab FROM inc FULL JOIN bal ON {_MATCH('inc', 'bal')}),
merged AS (SELECT {_KEYED('ib', 'csh')}, netprofit, total_assets, total_liab, n_cashflow_act FROM ib FULL JOIN csh ON {_MATCH('ib', 'csh')})"""
_VALUES = ("netprofit", "total_assets", "total_liab", "n_cashflow_act")


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = panel.read(spark, sf_dir, "orders")
    quarter = F.date_trunc("quarter", "o_orderdate").cast("date")
    filed = o.select(
        F.col("o_orderkey").alias("version"), F.concat(F.lit("S"), (F.col("o_custkey") % 40).cast("string")).alias("symbol"), quarter.alias("end_date"), F.date_add(quarter, (100 + 7 * (F.col("o_orderkey") % 12)).cast("int")).alias("ann_date"),
        (1 + F.col("o_orderkey") % 3).cast("string").alias("report_type"), F.when(F.col("o_custkey") % 2 == 0, "a").alias("comp_type"), F.lit("q").alias("end_type"), F.col("o_totalprice").alias("v"), (F.col("o_orderkey") % 5).alias("part"),
    )
    v = F.col("v")
    parts = {"income": filed.where("part in (0, 1, 2)").withColumn("netprofit", v), "balance": filed.where("part in (1, 2, 3)").withColumns({"total_assets": v * 10, "total_liab": v * 4}), "cashflow": filed.where("part in (2, 3, 4)").withColumn("n_cashflow_act", v / 2)}
    return statements.merge_statements(parts, {"income": ["netprofit"], "balance": ["total_assets", "total_liab"], "cashflow": ["n_cashflow_act"]}, "version")


@register("statement_merge", f"WITH {_MERGED} SELECT {_SK.replace('comp_type', "coalesce(comp_type, '') AS comp_type")}, {', '.join(f'round({v}, 4) AS {v}' for v in _VALUES)} FROM merged")
def statement_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merged(spark, sf_dir).withColumn("comp_type", F.coalesce("comp_type", F.lit("")))
    return rounded(out, statements.STATEMENT_KEYS, list(_VALUES), 4)


_DATES = [dt.date(1993, 6, 30), dt.date(1995, 1, 15), dt.date(1998, 12, 31)]


@register("statements_as_of", f"""WITH {_MERGED}, cut AS (SELECT unnest([{', '.join(f"DATE '{d}'" for d in _DATES)}]) AS as_of),
p AS (SELECT as_of, merged.*, row_number() OVER (PARTITION BY as_of, symbol, comp_type, end_date ORDER BY report_type, ann_date DESC) AS k FROM merged JOIN cut ON ann_date <= as_of)
SELECT as_of, symbol, coalesce(comp_type, '') AS comp_type, end_date, ann_date, report_type, {', '.join(f'round({v}, 4) AS {v}' for v in _VALUES)} FROM p WHERE k = 1""")
def statements_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = statements.known_versions(merged(spark, sf_dir), F.col("report_type"), ["symbol", "comp_type"])
    out = statements.as_of(versions, _DATES).withColumn("comp_type", F.coalesce("comp_type", F.lit("")))
    return rounded(out, ["as_of", "symbol", "comp_type", "end_date", "ann_date", "report_type"], list(_VALUES), 4)


_T = portfolio_queries._TRADES
_CLOSED = f"""{_T}, ev AS (SELECT market, asset_id, date AS decision_date, exit_date AS date, round(weighted, 10) AS r FROM trades WHERE reject IS NULL)"""


def closed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = portfolio_queries.trades_of(spark, sf_dir)[1].where("reject is null")
    return t.select("market", "asset_id", F.col("signal_date").alias("decision_date"), F.col("exit_date").alias("date"), F.round("weighted_return", 10).alias("period_return"))


@register("closed_return_risk", f"""WITH {_CLOSED},
dd AS (SELECT DISTINCT market, decision_date FROM ev),
cl AS (SELECT dd.market, dd.decision_date, ev.r, row_number() OVER (PARTITION BY dd.market, dd.decision_date ORDER BY greatest(ev.date, ev.decision_date) DESC, ev.date DESC, ev.decision_date DESC, ev.asset_id DESC) AS k FROM dd JOIN ev ON ev.market = dd.market AND ev.date <= dd.decision_date AND ev.decision_date < dd.decision_date),
pr AS (SELECT market, decision_date, sum(r) AS prior FROM cl WHERE k <= 9 GROUP BY ALL),
ad AS (SELECT ev.*, coalesce(prior, 0) AS prior_sum, CASE WHEN round(coalesce(prior, 0), 9) < -0.01 THEN 0.5 ELSE 1.0 END AS self_exposure FROM ev LEFT JOIN pr USING (market, decision_date)),
eq AS (SELECT *, r * self_exposure AS adjusted_return, product(1 + r * self_exposure) OVER (PARTITION BY market ORDER BY date, decision_date, asset_id ROWS UNBOUNDED PRECEDING) AS equity FROM ad)
SELECT market, asset_id, decision_date, date, round(prior_sum, 6) + 0.0 AS prior_sum, self_exposure, round(adjusted_return, 6) + 0.0 AS adjusted_return, round(equity, 6) AS equity, round(equity / max(equity) OVER (PARTITION BY market ORDER BY date, decision_date, asset_id ROWS UNBOUNDED PRECEDING) - 1, 6) + 0.0 AS drawdown FROM eq""")
def closed_return_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = overlays.closed_return_risk(closed_events(spark, sf_dir), ["market"], 9, -0.01, 0.5, "asset_id")
    return rounded(out, ["market", "asset_id", "decision_date", "date"], ["prior_sum", "self_exposure", "adjusted_return", "equity", "drawdown"])


_FEATURES = f"""ft AS (SELECT asset_id, date, {s.change('adj_close', 5)} AS return_5, {s.roll('avg', 'amount', 3)} / nullif({s.roll('avg', 'amount', 9)}, 0) AS amount_trend, (adj_close - {s.roll('min', 'low', 9)}) / nullif({s.roll('max', 'high', 9)} - {s.roll('min', 'low', 9)}, 0) AS close_location FROM bars),
fl AS (SELECT t.market, t.exit_date AS date, count(*) AS flagged_trades, sum(t.weighted) AS contribution, sum(abs(t.weighted)) AS abs_contribution FROM trades t JOIN ft USING (asset_id, date) WHERE reject IS NULL AND return_5 >= 0.05 AND amount_trend <= 1.2 AND close_location >= 0.3 GROUP BY ALL)"""
_TEMPLATE = f"{_T}, cu AS (SELECT market, exit_date AS date, sum(weighted) AS base_return FROM trades WHERE reject IS NULL GROUP BY ALL), te AS (SELECT * FROM cu WHERE week(date) % 6 <> 0), {_FEATURES}"


def excluded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A template of returns that lacks some periods, and the contributions of trades that a price-volume rule flags."""
    p, low = F.col("adj_close"), w.lowest("low", 9)
    rule = {"return_5": w.change(p, 5), "amount_trend": w.div(w.mean("amount", 3), w.mean("amount", 9)), "close_location": w.div(p - low, w.highest("high", 9) - low)}
    t = portfolio_queries.trades_of(spark, sf_dir, rule)[1]
    done = t.where("reject is null")
    flag = overlays.within({"return_5": (0.05, None), "amount_trend": (None, 1.2), "close_location": (0.3, None)})
    template = portfolio.equity(t, ["market"]).drop("equity").where(F.weekofyear("date") % 6 != 0)
    return template, overlays.flagged_contributions(done, flag, ["market"])


@register("trade_exclusion", f"WITH {_TEMPLATE} SELECT te.market, te.date, coalesce(flagged_trades, 0) AS flagged_trades, round(base_return, 6) + 0.0 AS base_return, round(coalesce(contribution, 0), 6) + 0.0 AS contribution, round(base_return - coalesce(contribution, 0), 6) + 0.0 AS period_return FROM te LEFT JOIN fl ON fl.market = te.market AND fl.date = te.date")
def trade_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    template, flagged = excluded(spark, sf_dir)
    out = overlays.exclude_from_template(template, flagged, ["market"])
    return rounded(out, ["market", "date", "flagged_trades"], ["base_return", "contribution", "period_return"])


@register("trade_exclusion_unmatched", f"""WITH {_TEMPLATE}, b AS (SELECT fl.*, te.date IS NOT NULL AS inside FROM fl LEFT JOIN te ON te.market = fl.market AND te.date = fl.date)
SELECT market, CAST(sum(flagged_trades) AS BIGINT) AS flagged_trades, CAST(coalesce(sum(flagged_trades) FILTER (inside), 0) AS BIGINT) AS matched_trades, CAST(coalesce(sum(flagged_trades) FILTER (NOT inside), 0) AS BIGINT) AS unmatched_trades, round(coalesce(sum(contribution) FILTER (inside), 0), 6) + 0.0 AS matched_contribution, round(coalesce(sum(contribution) FILTER (NOT inside), 0), 6) + 0.0 AS unmatched_contribution,
  round(coalesce(coalesce(sum(abs_contribution) FILTER (NOT inside), 0) / nullif(sum(abs_contribution), 0), 0), 6) AS unmatched_share FROM b GROUP BY market""")
def trade_exclusion_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = overlays.unmatched_contributions(*excluded(spark, sf_dir), ["market"])
    return rounded(out, ["market", "flagged_trades", "matched_trades", "unmatched_trades"], ["matched_contribution", "unmatched_contribution", "unmatched_share"])


_LATE = f"""{_T}, mk AS ({signal_queries._MASK.join(['WITH ', ' SELECT asset_id, date, adj_close, can_sell AND volume >= 20 AS sells FROM mask'])}),
tr AS (SELECT asset_id, market, date AS signal_date, entry_date, coalesce(exit_date, entry_date) AS exit_date, target_weight, cost_rate, can_buy AS entry_allowed FROM trades),
jo AS (SELECT tr.*, e.adj_close AS ep, x.date AS sold, x.adj_close AS xp FROM tr LEFT JOIN mk e ON e.asset_id = tr.asset_id AND e.date = tr.entry_date ASOF LEFT JOIN (SELECT * FROM mk WHERE sells) x ON x.asset_id = tr.asset_id AND x.date >= tr.exit_date),
st AS (SELECT *, CASE WHEN NOT entry_allowed THEN 'entry_blocked' WHEN ep IS NULL OR ep <= 0 THEN 'missing_entry_price' WHEN sold IS NULL OR datediff('day', exit_date, sold) > 20 THEN 'unresolved_exit' WHEN xp <= 0 THEN 'missing_exit_price' WHEN sold = exit_date THEN 'same_day_exit' ELSE 'delayed_exit' END AS status FROM jo)"""


@register("delayed_exits", f"""WITH {_LATE} SELECT signal_date, asset_id, market, entry_date, exit_date, CASE WHEN status IN ('same_day_exit', 'delayed_exit') THEN sold ELSE exit_date END AS delayed_exit_date, CAST(CASE WHEN status = 'delayed_exit' THEN datediff('day', exit_date, sold) ELSE 0 END AS INTEGER) AS exit_delay_days, status AS delayed_exit_status,
  round(CASE WHEN status IN ('same_day_exit', 'delayed_exit') THEN xp / ep - 1 ELSE 0 END, 6) + 0.0 AS delayed_gross_return, round(CASE WHEN status IN ('same_day_exit', 'delayed_exit') THEN (xp / ep - 1 - cost_rate) * target_weight ELSE 0 END, 6) + 0.0 AS delayed_weighted_return FROM st""")
def delayed_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, t = portfolio_queries.trades_of(spark, sf_dir)
    mask = signals.tradeability_mask(bars, signal_queries.attributes(bars), signal_queries.POLICY)
    mask = mask.select("asset_id", "date", "adj_close", (F.col("can_sell") & (F.col("volume") >= 20)).alias("can_sell"))
    rows = t.select("signal_date", "asset_id", "market", "entry_date", F.coalesce("exit_date", "entry_date").alias("exit_date"), "target_weight", "cost_rate", (F.coalesce("reject", F.lit("")) != "entry_not_tradeable").alias("entry_allowed"))
    out = overlays.delayed_exits(rows, mask, 20)
    return rounded(out, ["signal_date", "asset_id", "market", "entry_date", "exit_date", "delayed_exit_date", "exit_delay_days", "delayed_exit_status"], ["delayed_gross_return", "delayed_weighted_return"])


# the quarterly snapshot of a market's index: the assets with most turnover in the quarter, weighted by it
_SNAP = f"""{s.BARS}, qv AS (SELECT market, CAST(date_trunc('quarter', date) AS DATE) AS date, asset_id, sum(CAST(amount AS DECIMAL(18, 2))) AS v FROM bars GROUP BY ALL),
qk AS (SELECT *, row_number() OVER (PARTITION BY market, date ORDER BY v DESC, asset_id) AS k FROM qv), sn AS (SELECT market, date, asset_id, round(CAST(v AS DOUBLE) / CAST(sum(v) OVER (PARTITION BY market, date) AS DOUBLE), 6) AS weight FROM qk WHERE k <= 8)"""


def index_snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    bars = panel.bars(spark, sf_dir)
    by_quarter = bars.groupBy("market", F.date_trunc("quarter", "date").cast("date").alias("date"), "asset_id").agg(F.sum(F.col("amount").cast("decimal(18,2)")).alias("v"))
    ranked = by_quarter.withColumn("k", w.first_rank("v", ("market", "date"), down=True)).where("k <= 8")
    share = F.round(F.col("v").cast("double") / F.sum("v").over(w.cross(("market", "date"))).cast("double"), 6)
    return bars, ranked.select("market", "date", "asset_id", share.alias("weight"))


@register("index_events", f"""WITH {_SNAP}, dd AS (SELECT market, date, lag(date) OVER (PARTITION BY market ORDER BY date) AS prev FROM (SELECT DISTINCT market, date FROM sn)),
nw AS (SELECT sn.*, prev FROM sn JOIN dd USING (market, date) WHERE prev IS NOT NULL), od AS (SELECT sn.market, dd.date, sn.asset_id, sn.weight FROM sn JOIN dd ON dd.market = sn.market AND dd.prev = sn.date),
ch AS (SELECT coalesce(nw.market, od.market) AS market, coalesce(nw.date, od.date) AS event_date, coalesce(nw.asset_id, od.asset_id) AS asset_id, od.weight AS before, nw.weight AS now FROM nw FULL JOIN od ON nw.market = od.market AND nw.date = od.date AND nw.asset_id = od.asset_id),
ty AS (SELECT *, CASE WHEN before IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' WHEN abs(now - before) >= 0.02 THEN 'weight_changed' END AS event_type FROM ch)
SELECT market, asset_id, event_date, event_type, coalesce(CAST((SELECT min(date) FROM bars WHERE date > event_date) AS VARCHAR), '') AS available_date, coalesce(before, 0) AS prior_weight, coalesce(now, 0) AS current_weight, round(coalesce(now, 0) - coalesce(before, 0), 6) + 0.0 AS weight_change FROM ty WHERE event_type IS NOT NULL""")
def index_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, snapshots = index_snapshots(spark, sf_dir)
    out = overlays.snapshot_changes(snapshots, 0.02, ("market",), "asset_id", bars)
    out = out.withColumn("available_date", F.coalesce(F.col("available_date").cast("string"), F.lit("")))
    return rounded(out, ["market", "asset_id", "event_date", "event_type", "available_date"], ["prior_weight", "current_weight", "weight_change"])
