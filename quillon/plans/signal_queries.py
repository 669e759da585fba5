"""Filters, masks, session classes, capacity and evidence around signals, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import panel
from ..functions import windows as w
from ..operators import asof, evaluate, portfolio, signals
from . import core_queries, portfolio_queries, research_queries
from . import sqltext as s
from .registry import register, rounded

_MOM, _TOP = portfolio_queries._MOM, portfolio_queries._TOP
_FKEYS = ["date", "market", "factor_name", "asset_id"]
_R = lambda c, n=6: f"round({c}, {n}) + 0.0 AS {c}"
_A = "PARTITION BY asset_id ORDER BY date"


@register("signal_window", f"WITH {_MOM} SELECT date, market, factor_name, asset_id, {_R('factor_value')} FROM v WHERE date BETWEEN DATE '1994-01-01' AND DATE '1996-06-30'")
def signal_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = portfolio_queries.momentum(spark, sf_dir)[1].where("factor_value is not null")
    return rounded(signals.signal_window(f, "1994-01-01", "1996-06-30"), _FKEYS, ["factor_value"])


@register("min_signal_amount", f"""WITH {_MOM}, a AS (SELECT asset_id, date, amount, {s.roll('avg', 'amount', 4)} AS mean4 FROM bars)
SELECT v.date, v.market, factor_name, v.asset_id, {_R('factor_value')}, round(coalesce(amount, 0), 2) AS signal_amount, round(mean4, 4) AS average_amount FROM v JOIN a USING (asset_id, date) WHERE coalesce(amount, 0) >= 30000 AND mean4 >= 60000""")
def min_signal_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, f = portfolio_queries.momentum(spark, sf_dir)
    kept = signals.min_average_amount(signals.min_signal_amount(f.where("factor_value is not null"), bars, 30_000.0), bars, 60_000.0, 4)
    return kept.select(*_FKEYS, (F.round("factor_value", 6) + F.lit(0.0)).alias("factor_value"), F.round("signal_amount", 2).alias("signal_amount"), F.round("average_amount", 4).alias("average_amount"))


@register("scaled_sleeves", f"WITH {_TOP} SELECT date, market, factor_name, asset_id, round(target_weight * least(2 / 5.0, 1.0) * 0.9, 8) AS target_weight FROM top")
def scaled_sleeves(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = portfolio.select_top(portfolio_queries.momentum(spark, sf_dir)[1], 3)
    return rounded(signals.scale_sleeves(top, hold=5, every=2, gross=0.9), _FKEYS, ["target_weight"], 8)


#: Lifecycles and suspensions are derived from the bars, as the data has none.
_ASSETS = """life AS (SELECT asset_id, market, min(date) AS first, max(date) AS last FROM bars GROUP BY ALL),
attr AS (SELECT asset_id, market, CASE asset_id % 10 WHEN 1 THEN 'star' WHEN 2 THEN 'chinext' WHEN 3 THEN 'bse' ELSE 'main' END AS board, asset_id % 17 = 0 AS special,
  CAST(first - CAST(CAST(asset_id AS INTEGER) % 5 * 30 AS INTEGER) + 30 AS DATE) AS list_date, CASE WHEN asset_id % 7 = 0 THEN CAST(last - 56 AS DATE) END AS delist_date FROM life)"""


def attributes(bars: DataFrame) -> DataFrame:
    i = F.col("asset_id")
    life = bars.groupBy("asset_id", "market").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    board = F.when(i % 10 == 1, "star").when(i % 10 == 2, "chinext").when(i % 10 == 3, "bse").otherwise("main")
    return life.select("asset_id", "market", board.alias("board"), (i % 17 == 0).alias("special"), F.date_add("first", (30 - i % 5 * 30).cast("int")).alias("list_date"), F.when(i % 7 == 0, F.date_sub("last", 56)).alias("delist_date"))


_MASK = f"""{s.BARS}, {_ASSETS},
pr AS (SELECT b.*, adj_close AS close, {s.lag('adj_close')} AS pc FROM bars b), j AS (SELECT pr.*, board, special, list_date, delist_date, CASE WHEN special THEN 0.05 WHEN board = 'bse' THEN 0.3 WHEN board IN ('star', 'chinext') THEN 0.2 ELSE 0.1 END AS lim FROM pr LEFT JOIN attr USING (asset_id)),
fl AS (SELECT *, least(open, high, low, close, volume, amount) <= 0 AS suspended, coalesce(pc > 0 AND close >= pc * (1 + lim - 0.002) AND high <= close * 1.002, false) AS limit_up, coalesce(pc > 0 AND close <= pc * (1 - lim + 0.002) AND low >= close * 0.998, false) AS limit_down,
  special AS special_treatment, datediff('day', list_date, date) < 120 AS new_listing, coalesce(date >= delist_date, false) AS delisted, board NOT IN ('main', 'star') AS board_blocked FROM j),
mask AS (SELECT *, NOT (suspended OR special_treatment OR new_listing OR delisted OR board_blocked OR limit_up) AS can_buy, NOT (suspended OR special_treatment OR new_listing OR delisted OR board_blocked OR limit_down) AS can_sell,
  concat_ws(';', CASE WHEN suspended THEN 'suspended' END, CASE WHEN limit_up THEN 'limit_up' END, CASE WHEN limit_down THEN 'limit_down' END, CASE WHEN special_treatment THEN 'special_treatment' END, CASE WHEN new_listing THEN 'new_listing' END, CASE WHEN delisted THEN 'delisted' END, CASE WHEN board_blocked THEN 'board_blocked' END) AS blocked_reasons FROM fl)"""
POLICY = signals.Policy(boards=("main", "star"))


@register("tradeability_mask", f"WITH {_MASK} SELECT asset_id, market, date, board, can_buy, can_sell, blocked_reasons FROM mask")
def tradeability_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = panel.bars(spark, sf_dir)
    return signals.tradeability_mask(bars, attributes(bars), POLICY).select("asset_id", "market", "date", "board", "can_buy", "can_sell", "blocked_reasons")


@register("prerank_replacement", f"""WITH {_MASK}, f AS (SELECT asset_id, market, date, {s.change('adj_close', 5)} AS x FROM bars), rk AS (SELECT *, row_number() OVER (PARTITION BY date, market ORDER BY x DESC, asset_id) AS rank_before FROM f WHERE x IS NOT NULL),
g AS (SELECT rk.*, row_number() OVER (PARTITION BY rk.date, rk.market ORDER BY x DESC, rk.asset_id) AS rank FROM rk JOIN mask ON mask.asset_id = rk.asset_id AND mask.date = rk.date AND can_buy)
SELECT date, market, asset_id, rank_before, rank, round(1.0 / count(*) OVER (PARTITION BY date, market), 6) AS target_weight FROM g WHERE rank <= 3""")
def prerank_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, f = portfolio_queries.momentum(spark, sf_dir)
    mask = signals.tradeability_mask(bars, attributes(bars), POLICY)
    return signals.replace_blocked(f, mask, 3).select("date", "market", "asset_id", "rank_before", "rank", F.round("target_weight", 6).alias("target_weight"))


@register("session_classes", f"""WITH {s.BARS}, {_ASSETS}, d AS (SELECT DISTINCT market, date FROM bars),
gap AS (SELECT l.asset_id, l.market, d.date FROM life l JOIN d ON d.market = l.market AND d.date BETWEEN l.first AND l.last ANTI JOIN bars b ON b.asset_id = l.asset_id AND b.date = d.date)
SELECT g.asset_id, g.market, g.date, CASE WHEN g.date < a.list_date THEN 'before_list_date' WHEN g.date > a.delist_date THEN 'after_delist_date' WHEN g.asset_id % 4 = 0 AND month(g.date) = 2 THEN 'daily_suspension'
  WHEN g.asset_id % 3 = 0 AND ((g.date >= l.first + 200 AND g.date < l.first + 300) OR g.date >= l.last - 100) THEN 'interval_suspension' WHEN a.asset_id IS NULL THEN 'missing_lifecycle' ELSE 'unresolved' END AS session_class
FROM gap g JOIN life l USING (asset_id) LEFT JOIN (SELECT * FROM attr WHERE asset_id % 11 > 0) a USING (asset_id)""")
def session_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = panel.bars(spark, sf_dir)
    life = bars.groupBy("asset_id", "market").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    days = bars.select("market", "date").distinct()
    daily = life.where("asset_id % 4 = 0").join(days.where("month(date) = 2"), "market").select("asset_id", "date")
    third = life.where("asset_id % 3 = 0")
    spans = third.selectExpr("asset_id", "date_add(first, 200) AS suspend_date", "date_add(first, 300) AS resume_date").union(third.selectExpr("asset_id", "date_sub(last, 100)", "CAST(NULL AS DATE)"))
    return signals.session_classes(bars, attributes(bars).where("asset_id % 11 > 0"), daily, spans)


_TAIL = core_queries._IC.replace("FROM merged)", "FROM merged JOIN tops USING (date, market, factor_name, asset_id))", 1).replace("ranked AS (", "tops AS (SELECT date, market, factor_name, asset_id FROM (SELECT *, row_number() OVER (PARTITION BY date, market, factor_name ORDER BY factor_value DESC, asset_id) AS k FROM factors WHERE factor_value IS NOT NULL) WHERE k <= 12),\nranked AS (", 1)


@register("tail_ic", f"WITH {_TAIL} SELECT date, market, factor_name, horizon, execution_lag, n AS count, round(ic, 6) + 0.0 AS ic, round(rank_ic, 6) + 0.0 AS rank_ic FROM ic0")
def tail_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations within the selected positions only."""
    factors, labels = core_queries.study(spark, sf_dir)
    top = portfolio.select_top(factors, 12).select(*factors.columns)
    ic = evaluate.information_coefficient(top, labels, p_values=False)
    return rounded(ic, ["date", "market", "factor_name", "horizon", "execution_lag", "count"], ["ic", "rank_ic"])


@register("session_after_own_bars", f"""WITH {research_queries._MOVED}, mk AS (SELECT DISTINCT asset_id, market FROM moved), ev AS (SELECT asset_id, market, available_date, v FROM fd JOIN mk USING (asset_id)),
d AS (SELECT asset_id, date, row_number() OVER ({_A}) AS i FROM (SELECT DISTINCT asset_id, date FROM moved)), k AS (SELECT ev.*, (SELECT count(*) FROM d WHERE d.asset_id = ev.asset_id AND d.date < ev.available_date) + 1 AS t FROM ev)
SELECT k.asset_id, k.market, k.available_date, k.v, d.date AS signal_date FROM k JOIN d ON d.asset_id = k.asset_id AND d.i = k.t""")
def session_after_own_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The asset's own first bar on or after an event."""
    b, f = research_queries.shifted(spark, sf_dir)
    events = f.join(b.select("asset_id", "market").distinct(), "asset_id").select("asset_id", "market", "available_date", "v")
    return asof.session_after(events, b, "available_date", strict=False, key="asset_id")


@register("event_windows", f"""WITH {research_queries._MOVED}, mk AS (SELECT DISTINCT asset_id, market FROM moved), ev AS (SELECT asset_id, market, available_date, v FROM fd JOIN mk USING (asset_id)),
d AS (SELECT market, date, row_number() OVER (PARTITION BY market ORDER BY date) AS i FROM (SELECT DISTINCT market, date FROM moved)),
h AS (SELECT ev.*, (SELECT count(*) FROM d WHERE d.market = ev.market AND d.date < ev.available_date) + 1 AS t FROM ev), o AS (SELECT h.*, unnest([-2, -1, 0, 1, 2]) AS "offset" FROM h)
SELECT o.asset_id, o.market, o.available_date, o.v, o."offset", d.date AS session_date FROM o JOIN d ON d.market = o.market AND d.i = o.t + o."offset" """)
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, f = research_queries.shifted(spark, sf_dir)
    events = f.join(b.select("asset_id", "market").distinct(), "asset_id").select("asset_id", "market", "available_date", "v")
    return signals.event_windows(events, b, "available_date", 2, 2)


@register("latest_preceding_pair", f"WITH {research_queries._MOVED}, l AS (SELECT asset_id, available_date AS express_date, v AS express FROM fd WHERE n % 2 = 1), r AS (SELECT asset_id, available_date AS forecast_date, v AS forecast FROM fd WHERE n % 2 = 0) SELECT l.asset_id, express_date, express, forecast, r.forecast_date AS as_of FROM l ASOF JOIN r ON l.asset_id = r.asset_id AND l.express_date >= r.forecast_date")
def latest_preceding_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, f = research_queries.shifted(spark, sf_dir)
    left = f.where("n % 2 = 1").selectExpr("asset_id", "available_date AS express_date", "v AS express")
    right = f.where("n % 2 = 0").selectExpr("asset_id", "available_date AS forecast_date", "v AS forecast")
    return signals.latest_before(left, right, ["asset_id"], "express_date", "forecast_date", ["forecast"])


_CASES = research_queries._CASES


@register("overlap_stats", f"""WITH {_CASES}, v AS (SELECT market, case_no, date, r, row_number() OVER (PARTITION BY market, case_no ORDER BY date) AS i, r - avg(r) OVER (PARTITION BY market, case_no) AS d FROM ls WHERE r IS NOT NULL),
b AS (SELECT market, case_no, count(*) AS n, avg(r) AS mu, var_samp(r) AS va FROM v GROUP BY ALL HAVING count(*) > 1 AND var_samp(r) > 0),
k AS (SELECT market, case_no, n, mu, va, least(4, n - 1) AS max_lag FROM b),
g AS (SELECT x.market, x.case_no, x.i - y.i AS lag, sum(x.d * y.d) AS s FROM v x JOIN v y USING (market, case_no) WHERE x.i - y.i BETWEEN 0 AND 4 GROUP BY ALL),
l AS (SELECT k.*, greatest(0, (SELECT sum(CASE WHEN lag = 0 THEN s ELSE 2 * (1 - lag / (max_lag + 1.0)) * s END) FROM g WHERE g.market = k.market AND g.case_no = k.case_no AND lag <= max_lag) / (n - 1)) AS lr,
  (SELECT max(CASE WHEN lag = 1 THEN s END) / max(CASE WHEN lag = 0 THEN s END) FROM g WHERE g.market = k.market AND g.case_no = k.case_no) AS a1 FROM k)
SELECT market, case_no, n, max_lag, {', '.join(f'round({e}, 6) + 0.0 AS {c}' for c, e in {'mean_return': 'mu', 'naive_sharpe': 'mu / sqrt(va) * sqrt(52.0)', 'adjusted_sharpe': 'coalesce(mu / nullif(sqrt(lr), 0) * sqrt(52.0), 0)', 'variance_inflation': 'CASE WHEN lr > 0 THEN lr / va ELSE 1 END', 'effective_n': 'least(n, n / (CASE WHEN lr > 0 THEN lr / va ELSE 1 END))', 't_stat': 'coalesce(mu / nullif(sqrt(lr / n), 0), 0)', 'first_autocorrelation': 'a1'}.items())} FROM l""")
def overlap_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = signals.overlap_stats(research_queries.case_curves(spark, sf_dir), ["market", "case_no"], 5, 52.0)
    return rounded(out.withColumn("first_autocorrelation", F.try_element_at("autocorrelations", F.lit(1))), ["market", "case_no", "n", "max_lag"], ["mean_return", "naive_sharpe", "adjusted_sharpe", "variance_inflation", "effective_n", "t_stat", "first_autocorrelation"])


@register("top_quantile_capacity", f"""WITH {core_queries._STUDY}, am AS (SELECT asset_id, date, {s.roll('avg', 'amount', 20)} AS adv FROM bars), m AS (SELECT merged.*, adv FROM merged LEFT JOIN am USING (asset_id, date)),
p AS (SELECT *, count(*) OVER (PARTITION BY {core_queries._G}) AS size, row_number() OVER (PARTITION BY {core_queries._G} ORDER BY factor_value, asset_id) AS i FROM m),
t AS (SELECT *, CASE WHEN adv > 0 THEN adv END AS paid FROM p WHERE size >= 5 AND greatest(0, CAST(ceil((i - 1) * 5.0 / (size - 1)) AS INTEGER) - 1) = 4),
a AS (SELECT market, factor_name, horizon, execution_lag, count(*) AS observations, count(paid) AS with_amount, median(paid) AS median_amount, quantile_cont(paid, 0.1) AS p10_amount FROM t GROUP BY ALL)
SELECT market, factor_name, horizon, execution_lag, observations, with_amount, round(median_amount, 2) AS median_amount, round(p10_amount, 2) AS p10_amount, round(with_amount / observations, 6) AS coverage, round(5000.0 / p10_amount, 6) AS participation, coalesce(5000.0 / p10_amount <= 0.2, false) AS within_limit FROM a""")
def top_quantile_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, keys = core_queries.study_rows(spark, sf_dir, {"adv": w.mean("amount", 20)})
    keys = [k for k in keys if k != "date"]
    out = signals.top_capacity(rows, keys, "adv", 50_000.0, 10, 0.2, 5)
    return out.select(*keys, "observations", "with_amount", F.round("median_amount", 2).alias("median_amount"), F.round("p10_amount", 2).alias("p10_amount"), F.round("coverage", 6).alias("coverage"), F.round("participation", 6).alias("participation"), "within_limit")


_EVIDENCE = f"""{core_queries._GROUPS}, ranked AS (SELECT *, {s.mean_rank('factor_value', core_queries._G)} AS fr, {s.mean_rank('forward_return', core_queries._G)} AS rr FROM merged),
ic0 AS (SELECT {core_queries._G}, CASE WHEN min(fr) < max(fr) AND min(rr) < max(rr) THEN corr(fr, rr) END AS rank_ic FROM ranked GROUP BY ALL),
qm AS (SELECT market, factor_name, horizon, execution_lag, quantile, avg(m) AS m FROM groups GROUP BY ALL), qs AS (SELECT *, CASE WHEN m > lag(m) OVER (PARTITION BY {core_queries._K} ORDER BY quantile) THEN 1.0 WHEN m <= lag(m) OVER (PARTITION BY {core_queries._K} ORDER BY quantile) THEN 0.0 END AS up FROM qm),
mono AS (SELECT {core_queries._K}, avg(up) AS monotonicity, max(CASE WHEN quantile = 5 THEN m END) - max(CASE WHEN quantile = 1 THEN m END) AS spread, count(*) AS buckets FROM qs GROUP BY ALL),
yr AS (SELECT {core_queries._K}, year(date) AS y, avg(rank_ic) AS mean FROM ic0 WHERE rank_ic IS NOT NULL GROUP BY ALL HAVING count(*) >= 12),
yy AS (SELECT {core_queries._K}, count(*) AS usable_years, avg(CASE WHEN round(mean, 12) > 0 THEN 1.0 ELSE 0.0 END) AS positive_year_rate, min(mean) AS worst_year FROM yr GROUP BY ALL)"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    factors, labels = core_queries.study(spark, sf_dir)
    keys = ["market", "factor_name", "horizon", "execution_lag"]
    shape = signals.monotonicity(evaluate.quantile_returns(factors, labels), keys)
    return shape.join(signals.yearly(evaluate.information_coefficient(factors, labels, p_values=False), keys), keys)


@register("factor_evidence", f"WITH {_EVIDENCE} SELECT market, factor_name, horizon, execution_lag, buckets, usable_years, round(monotonicity, 6) AS monotonicity, round(spread, 7) + 0.0 AS spread, round(positive_year_rate, 6) AS positive_year_rate, round(worst_year, 6) + 0.0 AS worst_year FROM mono JOIN yy USING ({core_queries._K})")
def factor_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monotonicity of buckets and the yearly information coefficient."""
    r = lambda c, n: (F.round(c, n) + F.lit(0.0)).alias(c)
    return evidence(spark, sf_dir).select("market", "factor_name", "horizon", "execution_lag", "buckets", "usable_years", r("monotonicity", 6), r("spread", 7), r("positive_year_rate", 6), r("worst_year", 6))


@register("research_blockers", f"""WITH {_EVIDENCE} SELECT market, factor_name, horizon, execution_lag, concat_ws(';', CASE WHEN coalesce(round(spread, 10) <= 0, true) THEN 'top_minus_bottom_quantile_not_positive' END, CASE WHEN coalesce(monotonicity < 0.5, true) THEN 'quantile_monotonicity_below_threshold' END,
  CASE WHEN usable_years < 3 THEN 'usable_years_below_threshold' END, CASE WHEN coalesce(positive_year_rate < 0.6, true) THEN 'positive_year_rate_below_threshold' END) AS blockers FROM mono JOIN yy USING ({core_queries._K})""")
def research_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [
        ("top_minus_bottom_quantile_not_positive", F.round("spread", 10) <= 0),
        ("quantile_monotonicity_below_threshold", F.col("monotonicity") < 0.5),
        ("usable_years_below_threshold", F.col("usable_years") < 3),
        ("positive_year_rate_below_threshold", F.col("positive_year_rate") < 0.6),
    ]
    out = signals.blockers(evidence(spark, sf_dir), rules)
    return out.select("market", "factor_name", "horizon", "execution_lag", F.concat_ws(";", "blockers").alias("blockers"))


_BENCH = f"rr AS (SELECT *, {s.change('adj_close')} AS r0 FROM bars), bm AS (SELECT market, date, coalesce(avg(r0), 0) AS br FROM rr GROUP BY ALL)"


@register("benchmark_comparison", f"""WITH {_CASES}, {_BENCH}, a AS (SELECT market, case_no, product(1 + r) - 1 AS sr FROM ls GROUP BY ALL), b AS (SELECT market, product(1 + br) - 1 AS br, pow(1.02, greatest(0, count(*) - 1) / 52.0) - 1 AS cr FROM bm GROUP BY ALL)
SELECT market, case_no, {', '.join(f'round({e}, 6) + 0.0 AS {c}' for c, e in {'strategy_return': 'sr', 'cash_return': 'cr', 'excess_over_cash': 'sr - cr'}.items())}, round(br / greatest(1, abs(br)), 6) AS benchmark_scaled, round((sr - br) / greatest(1, abs(br)), 6) AS relative_scaled FROM a JOIN b USING (market)""")
def benchmark_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = signals.compare_to_benchmark(research_queries.case_curves(spark, sf_dir), portfolio.benchmark_curve(panel.bars(spark, sf_dir)), ["market", "case_no"], ["market"], 0.02, 52.0)
    size = F.greatest(F.lit(1.0), F.abs("benchmark_return"))  # compounded weekly means can be astronomical; compared by digits
    out = out.withColumns({"benchmark_scaled": F.col("benchmark_return") / size, "relative_scaled": F.col("relative_return") / size})
    return rounded(out, ["market", "case_no"], ["strategy_return", "cash_return", "excess_over_cash", "benchmark_scaled", "relative_scaled"])


@register("regime_allowed_dates", f"""WITH {s.BARS}, {_BENCH}, e AS (SELECT *, product(1 + br) OVER (PARTITION BY market ORDER BY date ROWS UNBOUNDED PRECEDING) AS e FROM bm), m AS (SELECT market, date, e / nullif(lag(e, 8) OVER (PARTITION BY market ORDER BY date), 0) - 1 AS momentum FROM e)
SELECT market, date, round(momentum, 6) + 0.0 AS momentum, coalesce(momentum > 0, false) AS allowed FROM m""")
def regime_allowed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = signals.allowed_dates(portfolio.benchmark_curve(panel.bars(spark, sf_dir)), ["market"], 8)
    return out.select("market", "date", (F.round("momentum", 6) + F.lit(0.0)).alias("momentum"), "allowed")


@register("factor_pivot", f"WITH {s.BARS} SELECT asset_id, market, date, round({s.change('adj_close', 5)}, 6) + 0.0 AS momentum_5, round(volume / nullif({s.roll('avg', 'volume', 5)}, 0) - 1, 6) + 0.0 AS volume_change_5 FROM bars")
def factor_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    factors, _ = core_queries.study(spark, sf_dir)
    names = ["momentum_5", "volume_change_5"]
    return rounded(signals.wide(factors, names, ["asset_id", "market", "date"]), ["asset_id", "market", "date"], names)


BLENDS = signals.blend_weights([0, 1, 2, 3], 0.25, 2)
_BLENDS = ", ".join(f"({b}, {c}, {x})" for b, c, x in BLENDS)


@register("blend_grid", f"""WITH {_CASES}, w(blend, case_no, weight) AS (VALUES {_BLENDS}), z AS (SELECT blend, count(*) AS size FROM w GROUP BY ALL),
c AS (SELECT market, blend, date, sum(weight * r) AS r, count(*) AS n FROM ls JOIN w USING (case_no) GROUP BY ALL), d AS (SELECT c.* FROM c JOIN z USING (blend) WHERE n = size),
a AS (SELECT market, blend, count(*) AS periods, avg(r) AS mu, stddev_pop(r) AS sd FROM d GROUP BY ALL)
SELECT market, blend, periods, round(mu, 7) + 0.0 AS mean_return, round(coalesce(mu * 52.0 / nullif(sd * sqrt(52.0), 0), 0), 5) + 0.0 AS sharpe FROM a""")
def blend_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = signals.blends(research_queries.case_curves(spark, sf_dir), ["market"], "case_no", BLENDS)
    a = series.groupBy("market", "blend").agg(F.count(F.lit(1)).alias("periods"), F.avg("period_return").alias("mu"), F.stddev_pop("period_return").alias("sd"))
    sharpe = F.coalesce(w.div(F.col("mu") * 52.0, F.col("sd") * F.sqrt(F.lit(52.0))), F.lit(0.0))
    return a.select("market", "blend", "periods", (F.round("mu", 7) + F.lit(0.0)).alias("mean_return"), (F.round(sharpe, 5) + F.lit(0.0)).alias("sharpe"))
