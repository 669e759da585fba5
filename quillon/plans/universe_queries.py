"""Exclusions, funds, members, baskets, timing, state overlays, spreads, industry breadth and fold stability, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import panel
from ..functions import windows as w
from ..operators import evaluate, inputs, neutralize, overlays, portfolio, robustness, states, universe, validate
from . import core_queries, input_queries, portfolio_queries, repair_queries, research_queries, signal_queries
from . import sqltext as s
from .registry import register, rounded

KEYS = ["asset_id", "market", "date"]
_R = lambda c, n=6: f"round({c}, {n}) + 0.0"


# plain closes differ from adjusted ones by a factor that jumps at one bar of some assets
_PLAIN = f"""{s.BARS}, {signal_queries._ASSETS}, pb AS (SELECT * , adj_close / (CASE WHEN asset_id % 13 = 4 AND date >= DATE '1996-01-01' THEN 0.4 ELSE 1 END) AS close FROM bars),
qn AS (SELECT DISTINCT asset_id FROM bars WHERE asset_id % 19 = 3)"""


@register("exclusion_reasons", f"""WITH {_PLAIN}, rt AS (SELECT *, lag(CASE WHEN close > 0 THEN adj_close / close END IGNORE NULLS) OVER ({s.ASSET}) AS before, CASE WHEN close > 0 THEN adj_close / close END AS ratio FROM pb),
jp AS (SELECT asset_id, max(greatest(ratio / before, before / ratio)) > 2 AS jumps FROM rt GROUP BY ALL)
SELECT pb.asset_id, pb.market, pb.date, coalesce(CASE WHEN qn.asset_id IS NOT NULL THEN 'quarantined' WHEN jumps THEN 'ratio_jump' WHEN pb.date < list_date THEN 'unlisted' WHEN list_date IS NOT NULL AND pb.date > delist_date THEN 'delisted' WHEN list_date IS NULL THEN 'unknown' END, '') AS excluded
FROM pb JOIN jp USING (asset_id) LEFT JOIN qn ON qn.asset_id = pb.asset_id LEFT JOIN (SELECT * FROM attr WHERE asset_id % 23 <> 6) a ON a.asset_id = pb.asset_id""")
def exclusion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = panel.bars(spark, sf_dir)
    split = F.when((F.col("asset_id") % 13 == 4) & (F.col("date") >= F.lit("1996-01-01").cast("date")), 0.4).otherwise(1.0)
    plain = bars.withColumn("close", F.col("adj_close") / split)
    life = signal_queries.attributes(bars).where("asset_id % 23 != 6").select("asset_id", "list_date", "delist_date")
    out = universe.exclusion_reasons(plain, life, bars.select("asset_id").where("asset_id % 19 = 3"), 2.0, True)
    return out.select(*KEYS, F.coalesce("excluded", F.lit("")).alias("excluded"))


# parts as funds
_FUNDS = """fu AS (SELECT p_partkey, lower('F' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.sh' WHEN 1 THEN '.SZ' WHEN 2 THEN '.of' ELSE '.sz' END) AS symbol, p_name || CASE WHEN p_partkey % 3 <> 0 THEN ' etf' ELSE '' END AS name, CASE WHEN p_partkey % 7 = 0 THEN 'o' ELSE 'e' END AS market, CASE WHEN p_partkey % 5 = 0 THEN 'D' ELSE 'L' END AS status,
  CASE WHEN p_partkey % 11 <> 0 THEN CAST(DATE '1993-01-01' + CAST(p_partkey % 2000 AS INTEGER) AS DATE) END AS list_date, CASE WHEN p_partkey % 6 = 1 THEN CAST(DATE '1995-01-01' + CAST(p_partkey % 1500 AS INTEGER) AS DATE) END AS delist_date FROM part)"""


@register("active_funds", f"WITH {_FUNDS} SELECT upper(symbol) AS symbol, name, coalesce(CAST(list_date AS VARCHAR), '') AS listed FROM fu WHERE upper(market) = 'E' AND upper(name) LIKE '%ETF%' AND (upper(symbol) LIKE '%.SH' OR upper(symbol) LIKE '%.SZ') AND list_date <= DATE '1996-06-30' AND (delist_date IS NULL OR delist_date > DATE '1996-06-30')")
def active_funds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel.read(spark, sf_dir, "part")
    i = F.col("p_partkey")
    ending = F.when(i % 4 == 0, ".sh").when(i % 4 == 1, ".SZ").when(i % 4 == 2, ".of").otherwise(".sz")
    day = lambda first, n: F.date_add(F.lit(first).cast("date"), (i % n).cast("int"))
    funds = p.select(
        F.lower(F.concat(F.lit("F"), i.cast("string"), ending)).alias("symbol"), F.concat("p_name", F.when(i % 3 != 0, " etf").otherwise("")).alias("name"), F.when(i % 7 == 0, "o").otherwise("e").alias("market"), F.when(i % 5 == 0, "D").otherwise("L").alias("status"),
        F.when(i % 11 != 0, day("1993-01-01", 2000)).alias("list_date"), F.when(i % 6 == 1, day("1995-01-01", 1500)).alias("delist_date"),
    )
    return universe.active_funds(funds, "1996-06-30").select("symbol", "name", F.coalesce(F.col("list_date").cast("string"), F.lit("")).alias("listed"))


_MEMBERS = f"{portfolio_queries._MOM}, mb AS (SELECT asset_id, date, row_number() OVER ({s.ASSET}) AS history_rows, amount >= 20000 AS member FROM bars)"


@register("rotation_members", f"""WITH {_MEMBERS}, lv AS (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM mb WHERE member AND history_rows >= 20)
SELECT v.date, v.market, v.asset_id, {_R('factor_value')} AS factor_value FROM v JOIN lv USING (asset_id, date) WHERE n >= 6""")
def rotation_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, f = portfolio_queries.momentum(spark, sf_dir)
    membership = bars.select("asset_id", "date", F.row_number().over(w.by_asset()).alias("history_rows"), (F.col("amount") >= 20_000).alias("is_rotation_member"))
    twice = membership.unionByName(membership)  # repeated rows are one member
    return rounded(universe.rotation_members(f.where("factor_value is not null"), twice, 20, 6), ["date", "market", "asset_id"], ["factor_value"])


# order lines as holdings: an order's nation is the fund, its date the disclosure
_HELD = """hd AS (SELECT 'f' || (o_custkey % 12) AS fund, 's' || l_suppkey AS stock, CAST(date_trunc('month', o_orderdate) AS DATE) AS known_date, sum(CASE WHEN l_linenumber % 4 = 0 THEN -1 ELSE 1 END * CAST(l_extendedprice AS DECIMAL(18, 2))) AS mkv, max(CASE WHEN l_suppkey % 3 <> 0 THEN l_discount END) AS share FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""


@register("basket_weights", f"""WITH {_HELD}, bs AS (SELECT upper(fund) AS fund_symbol, upper(stock) AS stock_symbol, known_date, CASE WHEN mkv > 0 THEN CAST(mkv AS DOUBLE) ELSE share END AS basis FROM hd), ok AS (SELECT * FROM bs WHERE basis > 0),
nx AS (SELECT *, lead(known_date) OVER (PARTITION BY fund_symbol ORDER BY known_date) AS nxt FROM (SELECT DISTINCT fund_symbol, known_date FROM ok))
SELECT fund_symbol, stock_symbol, known_date, coalesce(CAST(CAST(nxt - 1 AS DATE) AS VARCHAR), '') AS end_date, {_R('basis / sum(basis) OVER (PARTITION BY fund_symbol, known_date)', 8)} AS weight FROM ok JOIN nx USING (fund_symbol, known_date)""")
def basket_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = universe.basket_weights(_holdings(spark, sf_dir)).withColumn("end_date", F.coalesce(F.col("end_date").cast("string"), F.lit("")))
    return rounded(out, ["fund_symbol", "stock_symbol", "known_date", "end_date"], ["weight"], 8)


def _holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = panel.read(spark, sf_dir, "lineitem").join(panel.read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    sign = F.when(F.col("l_linenumber") % 4 == 0, -1).otherwise(1)
    held = lines.groupBy(F.concat(F.lit("f"), (F.col("o_custkey") % 12).cast("string")).alias("fund_symbol"), "l_suppkey", F.date_trunc("month", "o_orderdate").cast("date").alias("known_date")).agg(F.sum(sign * F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("mkv"), F.max("l_discount").alias("top"))
    return held.withColumns({"stock_symbol": F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), "stk_mkv_ratio": F.when(F.col("l_suppkey") % 3 != 0, F.col("top"))})


_FILINGS = f"""{s.BARS}, fi AS (SELECT CAST(o_custkey % 100 + 1 AS BIGINT) AS asset_id, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS end0, CAST(CAST(date_trunc('quarter', o_orderdate) AS DATE) + CAST(o_orderkey % 60 - 2 AS INTEGER) AS DATE) AS ann0, o_orderkey FROM orders),
fm AS (SELECT fi.asset_id, market, CASE WHEN o_orderkey % 97 <> 5 THEN end0 END AS end_date, CASE WHEN o_orderkey % 89 <> 7 THEN ann0 END AS ann_date FROM fi JOIN (SELECT DISTINCT asset_id, market FROM bars) USING (asset_id))"""


@register("timing_audit", f"""WITH {_FILINGS}, qu AS (SELECT market, count(*) AS rows, count_if(ann_date IS NULL) AS missing_announcements, count_if(end_date IS NULL) AS missing_periods, count_if(ann_date < end_date) AS early_announcements FROM fm GROUP BY market),
wh AS (SELECT * FROM fm WHERE ann_date IS NOT NULL AND end_date IS NOT NULL), sa AS (SELECT asset_id, market, end_date, ann_date, count(*) AS n FROM wh GROUP BY ALL),
rv AS (SELECT market, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS duplicate_rows FROM sa GROUP BY market), rp AS (SELECT market, count_if(k > 1) AS revised_periods FROM (SELECT asset_id, market, end_date, count(*) AS k FROM sa GROUP BY ALL) GROUP BY market),
dy AS (SELECT DISTINCT market, date FROM bars), sg AS (SELECT wh.market, wh.ann_date, d.date AS signal_date FROM wh ASOF LEFT JOIN dy d ON d.market = wh.market AND d.date > wh.ann_date),
mp AS (SELECT market, count(signal_date) AS mapped_rows, count_if(signal_date <= ann_date) AS early_signals, count_if(datediff('day', ann_date, signal_date) > 7) AS stale_signals, count_if(signal_date IS NULL) AS unmapped_rows FROM sg GROUP BY market)
SELECT market, rows, missing_announcements, missing_periods, early_announcements, duplicate_rows, revised_periods, coalesce(mapped_rows, 0) AS mapped_rows, coalesce(early_signals, 0) AS early_signals, coalesce(stale_signals, 0) AS stale_signals, coalesce(unmapped_rows, 0) AS unmapped_rows,
  concat_ws(';', CASE WHEN missing_announcements > 0 THEN 'missing_announcements' END, CASE WHEN missing_periods > 0 THEN 'missing_periods' END, CASE WHEN early_announcements > 0 THEN 'early_announcements' END, CASE WHEN duplicate_rows > 0 THEN 'duplicate_rows' END, CASE WHEN early_signals > 0 THEN 'early_signals' END, CASE WHEN stale_signals > 0 THEN 'stale_signals' END) AS blockers
FROM qu LEFT JOIN rv USING (market) LEFT JOIN rp USING (market) LEFT JOIN mp USING (market)""")
def timing_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, o = panel.bars(spark, sf_dir), panel.read(spark, sf_dir, "orders")
    quarter, k = F.date_trunc("quarter", "o_orderdate").cast("date"), F.col("o_orderkey")
    filed = o.select((F.col("o_custkey") % 100 + 1).cast("long").alias("asset_id"), F.when(k % 97 != 5, quarter).alias("end_date"), F.when(k % 89 != 7, F.date_add(quarter, (k % 60 - 2).cast("int"))).alias("ann_date"))
    return universe.timing_audit(filed.join(bars.select("asset_id", "market").distinct(), "asset_id"), bars, 7)


_CASES = research_queries._CASES
_RUN = "PARTITION BY market, case_no ORDER BY date ROWS UNBOUNDED PRECEDING"
_BEFORE = "PARTITION BY market, case_no ORDER BY date ROWS BETWEEN {} PRECEDING AND 1 PRECEDING"


@register("prior_state_risk", f"""WITH {_CASES}, st AS (SELECT *, coalesce(sum(r) OVER ({_BEFORE.format(21)}), 0) AS s21, coalesce(sum(r) OVER ({_BEFORE.format(42)}), 0) AS s42, coalesce(product(1 + r) OVER ({_BEFORE.format('UNBOUNDED')}), 1) AS pe FROM ls),
dd AS (SELECT *, coalesce(pe / nullif(max(pe) OVER ({_RUN}), 0) - 1, 0) AS pd FROM st), ex AS (SELECT *, CASE WHEN round(s21, 9) < -0.5 THEN 0.5 WHEN round(s42, 9) < -0.8 THEN 0.25 WHEN round(pd, 9) < -0.9 THEN 0.0 ELSE 1.0 END AS x FROM dd),
eq AS (SELECT *, product(1 + r * x) OVER ({_RUN}) AS e FROM ex)
SELECT market, CAST(case_no AS INTEGER) AS case_no, date, {_R('s21', 5)} AS prior_sum_21, {_R('s42', 5)} AS prior_sum_42, {_R('pd', 5)} AS prior_drawdown, x AS self_exposure, {_R('r * x')} AS period_return FROM eq""")
def prior_state_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = overlays.prior_state_risk(research_queries.case_curves(spark, sf_dir), ["market", "case_no"], [("prior_sum_21", -0.5, 0.5), ("prior_sum_42", -0.8, 0.25)], ("prior_drawdown", -0.9, 0.0))
    digits = {"prior_sum_21": 5, "prior_sum_42": 5, "prior_drawdown": 5, "self_exposure": 6, "period_return": 6}
    return out.select("market", "case_no", "date", *[(F.round(c, n) + F.lit(0.0)).alias(c) for c, n in digits.items()])


LOOKBACKS, THRESHOLDS, CAPS, DRAWDOWN = [4, 9], [0.0, -0.1], [0.5, 0.25], -0.3
_BENCHMARK = f"bq AS (SELECT market, date, coalesce(avg(r), 0) AS br FROM (SELECT *, {s.change('adj_close')} AS r FROM bars) GROUP BY ALL)"
_STATES = f"""be AS (SELECT *, product(1 + br) OVER (PARTITION BY market ORDER BY date ROWS UNBOUNDED PRECEDING) AS e FROM bq),
po AS (SELECT * FROM (SELECT unnest({LOOKBACKS}) AS lookback), (SELECT unnest([{', '.join(f'CAST({t} AS DOUBLE)' for t in THRESHOLDS)}]) AS threshold), (SELECT unnest([{', '.join(f'CAST({c} AS DOUBLE)' for c in CAPS)}]) AS cap_exposure)),
ss AS ({' UNION ALL '.join(f"SELECT market, date, {n} AS lookback, e / nullif(lag(e, {n}) OVER m, 0) - 1 AS mo, CASE WHEN count(e) OVER (m ROWS {n - 1} PRECEDING) >= {n} THEN e / nullif(max(e) OVER (m ROWS {n - 1} PRECEDING), 0) - 1 END AS dr FROM be WINDOW m AS (PARTITION BY market ORDER BY date)" for n in LOOKBACKS)}),
sx AS (SELECT market, date, lookback, threshold, cap_exposure, coalesce(mo <= threshold, false) OR coalesce(dr <= {DRAWDOWN}, false) AS stress FROM ss JOIN po USING (lookback)),
cp AS (SELECT market, date, lookback, threshold, cap_exposure, CASE WHEN lag(stress) OVER (PARTITION BY market, lookback, threshold, cap_exposure ORDER BY date) THEN cap_exposure ELSE 1.0 END AS cap FROM sx)"""


def _caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = portfolio.benchmark_curve(panel.bars(spark, sf_dir))
    return overlays.market_state_caps(bench, ["market"], LOOKBACKS, THRESHOLDS, DRAWDOWN, CAPS)


@register("market_state_grid", f"WITH {s.BARS}, {_BENCHMARK}, {_STATES} SELECT market, date, CAST(lookback AS INTEGER) AS lookback, threshold, cap_exposure, cap FROM cp")
def market_state_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _caps(spark, sf_dir)


@register("aligned_caps", f"""WITH {repair_queries._CLOSED}, {_BENCHMARK}, {_STATES}, ev2 AS (SELECT ev.market, asset_id, CAST(decision_date + 3 AS DATE) AS decision_date, date, r, lookback, threshold, cap_exposure FROM ev, po)
SELECT e.market, e.asset_id, e.decision_date, e.date, CAST(e.lookback AS INTEGER) AS lookback, e.threshold, e.cap_exposure, coalesce(c.cap, 1.0) AS cap, {_R('e.r * coalesce(c.cap, 1.0)')} AS capped_return FROM ev2 e ASOF LEFT JOIN cp c ON c.market = e.market AND c.lookback = e.lookback AND c.threshold = e.threshold AND c.cap_exposure = e.cap_exposure AND c.date <= e.decision_date""")
def aligned_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = repair_queries.closed_events(spark, sf_dir).withColumn("decision_date", F.date_add("decision_date", 3))  # between sessions
    out = overlays.align_caps(events, _caps(spark, sf_dir), ["market"], ["lookback", "threshold", "cap_exposure"])
    return rounded(out, ["market", "asset_id", "decision_date", "date", "lookback", "threshold", "cap_exposure"], ["cap", "capped_return"])


@register("hedged_spread", f"""WITH {_CASES}, {_BENCHMARK}, sl AS (SELECT market, date, r FROM ls WHERE case_no = 0 AND month(date) <> 5), bn AS (SELECT market, date, br AS gross, br - 0.001 AS net FROM bq WHERE month(date) <> 7),
sp AS (SELECT market, date, coalesce(r, 0) + 0.6 * (-coalesce(gross, 0) - (coalesce(gross, 0) - coalesce(net, 0))) AS period_return FROM sl FULL JOIN bn USING (market, date))
SELECT market, date, {_R('period_return')} AS period_return FROM sp""")
def hedged_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = research_queries.case_curves(spark, sf_dir).where("case_no = 0").where(F.month("date") != 5)
    bench = portfolio.benchmark_curve(panel.bars(spark, sf_dir)).where(F.month("date") != 7).withColumn("gross_return", F.col("period_return")).withColumn("period_return", F.col("period_return") - 0.001)
    return rounded(overlays.hedged_spread(own, bench, ["market"], 0.6), ["market", "date"], ["period_return"])


_SIZED = f"{portfolio_queries._TRADES}, sz AS (SELECT *, abs(gross) AS size FROM trades WHERE reject IS NULL)"


@register("extreme_trade_summary", f"""WITH {_SIZED} SELECT market, count(*) AS trades, count_if(size > 1.5) AS extreme_trades, {_R('max(size)')} AS max_size, {_R('quantile_cont(size, 0.99)')} AS p99_size, {_R('quantile_cont(part, 0.99)')} AS p99_participation, CAST(max(days) AS INTEGER) AS max_days, {_R('max(abs(weighted)) / nullif(sum(abs(weighted)), 0)')} AS top_weighted_share FROM sz GROUP BY market""")
def extreme_trade_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = overlays.extreme_trades(portfolio_queries.trades_of(spark, sf_dir)[1].where("reject is null"), ["market"], 1.5, 5)
    return rounded(out, ["market", "trades", "extreme_trades", "max_days"], ["max_size", "p99_size", "p99_participation", "top_weighted_share"])


@register("extreme_trades", f"""WITH {_SIZED}, pl AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY size DESC, asset_id, date) AS place FROM sz WHERE size > 1.5)
SELECT market, CAST(place AS INTEGER) AS place, asset_id, date AS signal_date, {_R('gross')} AS gross_return FROM pl WHERE place <= 5""")
def extreme_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, out = overlays.extreme_trades(portfolio_queries.trades_of(spark, sf_dir)[1].where("reject is null"), ["market"], 1.5, 5)
    return rounded(out, ["market", "place", "asset_id", "signal_date"], ["gross_return"])


_BRIDGE = f"""WITH {s.BARS}, {core_queries._LABELS}, f AS (SELECT asset_id, market, industry, date, {s.change('adj_close', 5)} AS factor_value FROM bars),
j AS (SELECT f.*, l.forward_return FROM f JOIN labels l ON l.asset_id = f.asset_id AND l.date = f.date AND l.horizon = 1 WHERE factor_value IS NOT NULL AND l.forward_return IS NOT NULL AND industry IS NOT NULL),
k AS (SELECT *, {s.rank('factor_value')} AS rk FROM j),
g AS (SELECT date, market, industry, count(DISTINCT asset_id) AS n, count(*) AS rows, round(avg(rk) + avg(CAST(rk >= 0.8 AS DOUBLE)) - avg(CAST(rk <= 0.2 AS DOUBLE)), 10) AS breadth, avg(forward_return) AS earned FROM k GROUP BY ALL),
a AS (SELECT *, sum(rows) OVER (PARTITION BY date, market) AS stocks FROM g), h AS (SELECT * FROM a WHERE n >= 2),
p AS (SELECT *, row_number() OVER (PARTITION BY date, market ORDER BY breadth DESC, industry) AS k, count(*) OVER (PARTITION BY date, market) AS m, {s.mean_rank('breadth', 'date, market')} AS br, {s.mean_rank('earned', 'date, market')} AS er FROM h),
o AS (SELECT date, market, CAST(max(stocks) AS BIGINT) AS stocks, max(m) AS industries, CASE WHEN min(br) < max(br) AND min(er) < max(er) THEN corr(br, er) END AS ic, avg(earned) FILTER (k <= least(1, greatest(1, m - 1))) AS t, avg(earned) AS al, avg(earned) FILTER (k > m - least(1, greatest(1, m - 1))) AS b FROM p GROUP BY ALL)
SELECT date, market, stocks, industries, industries >= 3 AS eligible, {', '.join(f"round(CASE WHEN industries >= 3 THEN {e} END, 6) + 0.0 AS {n}" for n, e in (('industry_rank_ic', 'ic'), ('top_return', 't'), ('all_return', 'al'), ('bottom_return', 'b'), ('excess_return', 't - al'), ('spread_return', 't - b')))} FROM o"""


@register("breadth_bridge", _BRIDGE)
def breadth_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = panel.bars(spark, sf_dir)
    labels = core_queries.labels.forward_returns(bars, (1,)).select("asset_id", "date", "forward_return")
    rows = bars.select("asset_id", "market", "industry", "date", w.change("adj_close", 5).alias("factor_value")).join(labels, ["asset_id", "date"])
    out = neutralize.breadth_bridge(rows, least_assets=2)
    return rounded(out, ["date", "market", "stocks", "industries", "eligible"], ["industry_rank_ic", "top_return", "all_return", "bottom_return", "excess_return", "spread_return"])


_SH = lambda part: f"coalesce(avg(r) FILTER ({part}) / CASE WHEN stddev_pop(r) FILTER ({part}) > 1e-12 THEN stddev_pop(r) FILTER ({part}) END * sqrt(52), 0)"
_TRAIN, _TEST = "ls.date BETWEEN train_start AND train_end", "ls.date BETWEEN test_start AND test_end"
_FOLDED = f"""{_CASES}, {research_queries._FOLDS}, fm AS (SELECT ls.market, fold, case_no, {_SH(_TRAIN)} AS a, {_SH(_TEST)} AS b, coalesce(product(1 + r) FILTER ({_TRAIN}) - 1, 0) AS ra, coalesce(product(1 + r) FILTER ({_TEST}) - 1, 0) AS rb, count(r) FILTER ({_TRAIN}) AS na, count(r) FILTER ({_TEST}) AS nb FROM ls JOIN folds USING (market) WHERE ls.date BETWEEN train_start AND test_end GROUP BY ALL),
fd AS (SELECT *, greatest(a - b, 0) AS degradation, b - greatest(a - b, 0) AS stability, concat_ws(';', CASE WHEN na = 0 THEN 'train_missing' END, CASE WHEN nb = 0 THEN 'test_missing' END, CASE WHEN round(b, 8) < 0 THEN 'test_sharpe_low' END, CASE WHEN round(rb, 8) < -0.2 THEN 'test_return_low' END, CASE WHEN round(greatest(a - b, 0), 8) > 1 THEN 'degradation_high' END) AS reasons FROM fm)"""


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    curves = research_queries.case_curves(spark, sf_dir)
    metrics = robustness.fold_metrics(curves, validate.rolling_folds(curves, 104, 26, ["market"]), ["market"], "case_no", 52.0)
    return robustness.fold_decisions(metrics, 0.0, -0.2, 1.0)


@register("fold_stability", f"WITH {_FOLDED} SELECT market, fold, CAST(case_no AS INTEGER) AS case_no, reasons, reasons = '' AS accepted, {_R('a', 5)} AS train_sharpe, {_R('b', 5)} AS test_sharpe, {_R('rb', 5)} AS test_return, {_R('degradation', 5)} AS degradation, {_R('stability', 5)} AS stability FROM fd")
def fold_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_folded(spark, sf_dir), ["market", "fold", "case_no", "reasons", "accepted"], ["train_sharpe", "test_sharpe", "test_return", "degradation", "stability"], 5)


@register("case_stability", f"WITH {_FOLDED} SELECT market, CAST(case_no AS INTEGER) AS case_no, count(*) AS folds, count_if(reasons = '') AS accepted_folds, {_R('avg(b)', 5)} AS mean_test_sharpe, {_R('min(rb)', 5)} AS worst_test_return, {_R('avg(degradation)', 5)} AS mean_degradation, {_R('avg(stability)', 5)} AS mean_stability FROM fd GROUP BY market, case_no")
def case_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = robustness.case_stability(_folded(spark, sf_dir), ["market"], "case_no")
    return rounded(out, ["market", "case_no", "folds", "accepted_folds"], ["mean_test_sharpe", "worst_test_return", "mean_degradation", "mean_stability"], 5)


@register("incremental_metrics", f"""WITH {_CASES}, pr AS (SELECT b.market, c.case_no, b.date, b.r AS x, c.r AS y FROM ls b JOIN ls c ON c.market = b.market AND c.date = b.date WHERE b.case_no = 0 AND c.case_no <> 0),
sp AS (SELECT *, unnest(['all', CAST(year(date) AS VARCHAR)]) AS span FROM pr), eq AS (SELECT *, product(1 + x) OVER w AS ex, product(1 + y) OVER w AS ey FROM sp WINDOW w AS (PARTITION BY market, case_no, span ORDER BY date ROWS UNBOUNDED PRECEDING)),
dd AS (SELECT *, ex / nullif(greatest(max(ex) OVER w, 1), 0) - 1 AS dx, ey / nullif(greatest(max(ey) OVER w, 1), 0) - 1 AS dy FROM eq WINDOW w AS (PARTITION BY market, case_no, span ORDER BY date ROWS UNBOUNDED PRECEDING)),
mt AS (SELECT market, case_no, span, count(*) AS periods, product(1 + x) - 1 AS rx, product(1 + y) - 1 AS ry, coalesce(avg(x) / CASE WHEN stddev_pop(x) > 1e-12 THEN stddev_pop(x) END * sqrt(52), 0) AS sx, coalesce(avg(y) / CASE WHEN stddev_pop(y) > 1e-12 THEN stddev_pop(y) END * sqrt(52), 0) AS sy, min(dx) AS mx, min(dy) AS my FROM dd GROUP BY ALL)
SELECT market, CAST(case_no AS INTEGER) AS case_no, span, periods, {_R('rx', 5)} AS base_return, {_R('ry', 5)} AS candidate_return, {_R('ry - rx', 5)} AS return_delta, {_R('sy - sx', 5)} AS sharpe_delta, {_R('my - mx', 5)} AS drawdown_delta FROM mt""")
def incremental_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = research_queries.case_curves(spark, sf_dir)
    out = robustness.incremental_metrics(c.where("case_no = 0"), c.where("case_no != 0"), ["market"], ["case_no"], 52.0)
    return rounded(out, ["market", "case_no", "span", "periods"], ["base_return", "candidate_return", "return_delta", "sharpe_delta", "drawdown_delta"], 5)


_BASKETS = f"""{_HELD}, bs AS (SELECT upper(fund) AS fund_symbol, CAST(substr(stock, 2) AS BIGINT) AS asset_id, known_date, CASE WHEN mkv > 0 THEN CAST(mkv AS DOUBLE) ELSE share END AS basis FROM hd), ok AS (SELECT * FROM bs WHERE basis > 0),
nx AS (SELECT *, lead(known_date) OVER (PARTITION BY fund_symbol ORDER BY known_date) AS nxt FROM (SELECT DISTINCT fund_symbol, known_date FROM ok)),
wt AS (SELECT fund_symbol, asset_id, known_date, nxt, basis / sum(basis) OVER (PARTITION BY fund_symbol, known_date) AS weight FROM ok JOIN nx USING (fund_symbol, known_date))"""
_PARTS = dict(zip(inputs.BASKET_FLOW, input_queries._MFE.values()))


@register("factors_basket_flow", f"""{input_queries._MF}, {_BASKETS}, rt AS (SELECT asset_id, date, {', '.join(f'({e}) / nullif(total, 0) AS {n}' for n, e in _PARTS.items())} FROM t),
jn AS (SELECT rt.*, fund_symbol, weight FROM rt JOIN wt ON wt.asset_id = rt.asset_id AND rt.date >= known_date AND (nxt IS NULL OR rt.date < nxt)),
sm AS (SELECT date, fund_symbol, sum(weight) AS w, count(DISTINCT asset_id) AS constituent_count, {', '.join(f'coalesce(sum(weight * {n}), 0) AS {n}' for n in _PARTS)}, sum(CASE WHEN etf_net_mf_amount_ratio > 0 THEN weight ELSE 0 END) AS {inputs.BASKET_FLOW[-1]} FROM jn GROUP BY ALL)
SELECT date, fund_symbol, constituent_count, round(w, 6) AS basket_weight_sum, {', '.join(f'round({n} / w, 6) + 0.0 AS {n}, round(-{n} / w, 6) + 0.0 AS {n}_low' for n in inputs.BASKET_FLOW)} FROM sm""")
def factors_basket_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    baskets = universe.basket_weights(_holdings(spark, sf_dir)).withColumn("asset_id", F.expr("cast(substr(stock_symbol, 2) as bigint)"))
    out = inputs.basket_flow(input_queries.flows(spark, sf_dir), baskets)
    return rounded(out, ["date", "fund_symbol", "constituent_count"], ["basket_weight_sum", *inputs.BASKET_FLOW, *[f"{n}_low" for n in inputs.BASKET_FLOW]])


@register("reference_riskoff", f"""WITH {_CASES}, {_BENCHMARK}, rf AS (SELECT market, date, br < -0.05 AS riskoff FROM bq WHERE month(date) <> 3)
SELECT ls.market, CAST(case_no AS INTEGER) AS case_no, ls.date, coalesce(riskoff, false) AS riskoff, {_R('r * CASE WHEN riskoff THEN 0.4 ELSE 1 END')} AS guarded_return FROM ls LEFT JOIN rf USING (market, date)""")
def reference_riskoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = portfolio.benchmark_curve(panel.bars(spark, sf_dir)).where(F.month("date") != 3).select("market", "date", (F.col("period_return") < -0.05).alias("riskoff"))
    out = overlays.reference_riskoff(research_queries.case_curves(spark, sf_dir), bench, ["market"], 0.4)
    return rounded(out, ["market", "case_no", "date", "riskoff"], ["guarded_return"])


# a rate released every month: the mean discount of the month's lines, missing now and then
_RELEASED = """rl AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS release_date, CASE WHEN month(date_trunc('month', l_shipdate)) % 5 <> 3 THEN round(avg(l_discount), 6) END AS released FROM lineitem GROUP BY date_trunc('month', l_shipdate)),
rf AS (SELECT *, last_value(released IGNORE NULLS) OVER (ORDER BY release_date ROWS UNBOUNDED PRECEDING) AS rate FROM rl), rc AS (SELECT *, round(rate - lag(rate) OVER (ORDER BY release_date), 9) AS change FROM rf WHERE rate IS NOT NULL),
ms AS (SELECT release_date, rate, released IS NULL AS repaired, change, CASE WHEN change IS NULL THEN 'unknown' WHEN change > 0.0005 THEN 'tightening' WHEN change < -0.0005 THEN 'easing' ELSE 'flat' END AS state FROM rc)"""


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.date_trunc("month", "l_shipdate").cast("date")
    released = panel.read(spark, sf_dir, "lineitem").groupBy(month.alias("release_date")).agg(F.avg("l_discount").alias("mean"))
    return states.macro_states(released.select("release_date", F.when(F.month("release_date") % 5 != 3, F.round("mean", 6)).alias("rate")), 0.0005)


@register("macro_states", f"WITH {_RELEASED} SELECT release_date, repaired, state, {_R('rate')} AS rate, {_R('change')} AS change FROM ms")
def macro_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_states(spark, sf_dir), ["release_date", "repaired", "state"], ["rate", "change"])


@register("state_conditioned_ic", f"""WITH {core_queries._IC}, {_RELEASED}, kn AS (SELECT CAST(release_date + 1 AS DATE) AS known_from, state FROM ms),
mt AS (SELECT i.market, i.factor_name, i.horizon, i.rank_ic, coalesce(k.state, 'unknown') AS state FROM (SELECT * FROM ic0 WHERE rank_ic IS NOT NULL) i ASOF LEFT JOIN kn k ON i.date >= k.known_from)
SELECT market, factor_name, horizon, state, count(*) AS n, {_R('avg(rank_ic)')} AS mean_ic, {_R('CASE WHEN count(*) > 1 THEN avg(rank_ic) * sqrt(count(*)) / CASE WHEN stddev_samp(rank_ic) > 1e-12 THEN stddev_samp(rank_ic) END END', 5)} AS t_stat, {_R('avg(CAST(round(rank_ic, 9) > 0 AS DOUBLE))')} AS positive_rate FROM mt GROUP BY market, factor_name, horizon, state""")
def state_conditioned_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    ic = evaluate.correlations(*core_queries.study_rows(spark, sf_dir), p_values=False).withColumn("rank_ic", F.round("rank_ic", 12))
    out = states.state_conditioned_ic(ic, _states(spark, sf_dir), ["market", "factor_name", "horizon"])
    return out.select("market", "factor_name", "horizon", "state", "n", (F.round("mean_ic", 6) + F.lit(0.0)).alias("mean_ic"), (F.round("t_stat", 5) + F.lit(0.0)).alias("t_stat"), (F.round("positive_rate", 6) + F.lit(0.0)).alias("positive_rate"))


@register("signal_snapshot", f"""WITH {core_queries._STUDY}, pa AS (SELECT * FROM factors WHERE date <= DATE '1997-05-15' AND factor_value IS NOT NULL), la AS (SELECT market, factor_name, max(date) AS date FROM pa GROUP BY ALL),
pk AS (SELECT *, row_number() OVER (PARTITION BY market, factor_name ORDER BY factor_value DESC, asset_id) AS k FROM pa JOIN la USING (market, factor_name, date)), pp AS (SELECT *, count(*) OVER (PARTITION BY market, factor_name) AS n FROM pk WHERE k <= 4),
pr AS (SELECT asset_id, arg_max(adj_close, date) AS price, max(date) AS price_date FROM bars WHERE date <= DATE '1997-05-15' GROUP BY ALL)
SELECT market, factor_name, date AS signal_date, asset_id, CAST(k AS INTEGER) AS rank, price_date, datediff('day', date, DATE '1997-05-15') > 5 AS stale, {_R('factor_value')} AS factor_value, {_R('least(1.0 / n, 0.2)')} AS weight, {_R('price')} AS price FROM pp LEFT JOIN pr USING (asset_id)""")
def signal_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, _ = core_queries.study(spark, sf_dir)
    out = states.signal_snapshot(f, panel.bars(spark, sf_dir), "1997-05-15", 4, 0.2, 5)
    return rounded(out, ["market", "factor_name", "signal_date", "asset_id", "rank", "price_date", "stale"], ["factor_value", "weight", "price"])
