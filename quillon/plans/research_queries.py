"""Neutralisation, point-in-time joins, quality checks and validation on the panel, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import panel
from ..functions import windows as w
from ..operators import asof, evaluate, neutralize, portfolio, quality, validate
from . import core_queries, portfolio_queries
from . import sqltext as s
from .registry import register, rounded

KEYS = ["asset_id", "market", "date"]
_X = "OVER (PARTITION BY date, market)"
_EXPOSED = [{"y": s.change("adj_close", 5), "x1": f"ln({s.roll('avg', 'amount', 10)})", "x2": s.roll("stddev_pop", "adj_close", 10)}]


def exposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A factor y and two exposures."""
    b = panel.bars(spark, sf_dir)
    return b.withColumns({"y": w.change("adj_close", 5), "x1": F.log(w.mean("amount", 10)), "x2": w.std("adj_close", 10)})


_FULL = "y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL"
_OLS = (
    s.chain(_EXPOSED)
    + f""",
c AS (SELECT *, y - avg(y) {_X} AS cy, x1 - avg(x1) {_X} AS c1, x2 - avg(x2) {_X} AS c2, count(*) {_X} AS n FROM last WHERE {_FULL}),
m AS (SELECT *, sum(c1 * c1) {_X} AS s11, sum(c2 * c2) {_X} AS s22, sum(c1 * c2) {_X} AS s12, sum(c1 * cy) {_X} AS s1y, sum(c2 * cy) {_X} AS s2y FROM c),
r AS (SELECT asset_id, market, date, CASE WHEN n >= 8 THEN cy - (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) * c1 - (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) * c2 END AS residual FROM m)
SELECT asset_id, market, date, round(residual, 6) + 0.0 AS residual FROM last LEFT JOIN r USING (asset_id, market, date)"""
)


@register("ols_residual", _OLS)
def ols_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(neutralize.ols_residual(exposed(spark, sf_dir), "y", ["x1", "x2"], least=8), KEYS, ["residual"])


@register("neutral_columns", s.final([
    *_EXPOSED,
    {"a": "CASE WHEN y IS NOT NULL AND x1 IS NOT NULL THEN y END", "b": "CASE WHEN y IS NOT NULL AND x1 IS NOT NULL THEN x1 END"},
    {"one_exposure": f"CASE WHEN min(b) {_X} < max(b) {_X} THEN a - regr_intercept(a, b) {_X} - regr_slope(a, b) {_X} * b END",
     "winsorized": f"CASE WHEN y IS NOT NULL THEN least(greatest(y, quantile_cont(y, 0.1) {_X}), quantile_cont(y, 0.9) {_X}) END",
     "industry_demeaned": "y - median(y) OVER (PARTITION BY date, market, industry)"},
], ["one_exposure", "winsorized", "industry_demeaned"]))
def neutral_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = exposed(spark, sf_dir)
    df = df.withColumns({"one_exposure": neutralize.rank_residual(df, "y", "x1"), "winsorized": neutralize.winsorize("y", 0.1, 0.9), "industry_demeaned": neutralize.median_demean("y")})
    return rounded(df, KEYS, ["one_exposure", "winsorized", "industry_demeaned"])


_BUCKET = "date, market, bucket"


@register("size_bucket_rank", s.chain(_EXPOSED) + f""",
p AS (SELECT *, row_number() OVER (PARTITION BY date, market ORDER BY x1, asset_id) AS r, count(*) {_X} AS n FROM last WHERE y IS NOT NULL AND x1 IS NOT NULL),
q AS (SELECT *, CASE WHEN n = 1 THEN 0 ELSE greatest(0, CAST(ceil((r - 1) * 5 / CAST(n - 1 AS DOUBLE)) AS INTEGER) - 1) END AS bucket FROM p)
SELECT asset_id, market, date, CAST(bucket AS INTEGER) AS bucket, round({s.rank('y', _BUCKET)}, 6) AS bucket_rank FROM q""")
def size_bucket_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neutralize.size_bucket_rank(exposed(spark, sf_dir).where("y is not null and x1 is not null"), "y", "x1")
    return out.select(*KEYS, "bucket", F.round("bucket_rank", 6).alias("bucket_rank"))


@register("industry_fit", s.chain(_EXPOSED) + f""",
d AS (SELECT date, market, y, avg(y) {_X} AS m, avg(y) OVER (PARTITION BY date, market, industry) AS g FROM last WHERE y IS NOT NULL)
SELECT date, market, round(CASE WHEN sum((y - m) * (y - m)) > 1e-18 THEN 1 - sum((y - g) * (y - g)) / sum((y - m) * (y - m)) END, 6) + 0.0 AS industry_r2, count(*) AS n FROM d GROUP BY ALL""")
def industry_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neutralize.industry_fit(exposed(spark, sf_dir), "y")
    return out.select("date", "market", (F.round("industry_r2", 6) + F.lit(0.0)).alias("industry_r2"), "n")


# point-in-time joins: the events table is a feed of values by asset, known on the day after the event
_FEED = "feed AS (SELECT CAST(user_id % 100 + 1 AS BIGINT) AS asset_id, CAST(ts AS DATE) + INTERVAL 1 DAY AS available0, round(sum(value), 6) AS v, count(*) AS n FROM events GROUP BY ALL), fd AS (SELECT asset_id, CAST(available0 AS DATE) AS available_date, v, n FROM feed)"
# events fall into a few weeks of one year; bars are shifted so that both overlap whatever the scale
_SHIFT = "sh AS (SELECT datediff('day', (SELECT min(date) FROM bars), (SELECT min(available_date) FROM fd)) AS k)"


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = panel.read(spark, sf_dir, "events")
    rows = e.groupBy((F.col("user_id") % 100 + 1).cast("long").alias("asset_id"), F.date_add(F.col("ts").cast("date"), 1).alias("available_date"))
    return rows.agg(F.round(F.sum("value"), 6).alias("v"), F.count(F.lit(1)).alias("n"))


def shifted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Bars with dates moved so that the first one meets the first known event, and the feed."""
    b, f = panel.bars(spark, sf_dir), feed(spark, sf_dir)
    k = b.agg(F.min("date").alias("a")).crossJoin(f.agg(F.min("available_date").alias("z"))).select(F.datediff("z", "a").alias("k"))
    return b.crossJoin(F.broadcast(k)).withColumn("date", F.date_add("date", F.col("k"))).drop("k"), f


_MOVED = f"{s.BARS}, {_FEED}, {_SHIFT}, moved AS (SELECT * EXCLUDE (date), CAST(date + k * INTERVAL 1 DAY AS DATE) AS date FROM bars, sh)"
_txt = lambda c: f"coalesce(CAST({c} AS VARCHAR), '')"


def _as_text(c: str):
    return F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)


@register("asof_by_asset", f"WITH {_MOVED} SELECT b.asset_id, b.market, b.date, f.v, f.n, {_txt('f.available_date')} AS as_of FROM moved b ASOF LEFT JOIN fd f ON b.asset_id = f.asset_id AND b.date >= f.available_date")
def asof_by_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, f = shifted(spark, sf_dir)
    return asof.asof_by_key(b.select(*KEYS), f, ["asset_id"], "date", "available_date", ["v", "n"]).select(*KEYS, "v", "n", _as_text("as_of"))


@register("asof_global", f"WITH {_MOVED}, st AS (SELECT available_date, round(sum(v), 4) AS total FROM fd GROUP BY ALL) SELECT b.asset_id, b.market, b.date, st.total, {_txt('st.available_date')} AS as_of FROM moved b ASOF LEFT JOIN st ON b.date >= st.available_date")
def asof_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, f = shifted(spark, sf_dir)
    states = f.groupBy("available_date").agg(F.round(F.sum("v"), 4).alias("total"))
    return asof.asof_global(b.select(*KEYS), states, "date", "available_date", ["total"]).select(*KEYS, "total", _as_text("as_of"))


@register("session_after_event", f"""WITH {_MOVED}, mk AS (SELECT DISTINCT asset_id, market FROM moved), ev AS (SELECT asset_id, market, available_date, v FROM fd JOIN mk USING (asset_id)),
d AS (SELECT market, date, row_number() OVER (PARTITION BY market ORDER BY date) AS i FROM (SELECT DISTINCT market, date FROM moved)),
k AS (SELECT ev.*, (SELECT count(*) FROM d WHERE d.market = ev.market AND d.date <= ev.available_date) + 1 + 1 AS t FROM ev)
SELECT k.asset_id, k.market, k.available_date, k.v, d.date AS signal_date FROM k JOIN d ON d.market = k.market AND d.i = k.t""")
def session_after_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, f = shifted(spark, sf_dir)
    events = f.join(b.select("asset_id", "market").distinct(), "asset_id").select("asset_id", "market", "available_date", "v")
    return asof.session_after(events, b, "available_date", extra=1).select("asset_id", "market", "available_date", "v", "signal_date")


_SPANS = "spans AS (SELECT asset_id, available_date AS valid_from, CASE WHEN n % 3 = 0 THEN NULL ELSE CAST(available_date + n * INTERVAL 5 DAY AS DATE) END AS valid_to, v AS weight FROM fd WHERE v > 0)"


def spans(f: DataFrame) -> DataFrame:
    until = F.when(F.col("n") % 3 != 0, F.date_add("available_date", (F.col("n") * 5).cast("int")))
    return f.where("v > 0").select("asset_id", F.col("available_date").alias("valid_from"), until.alias("valid_to"), F.col("v").alias("weight"))


@register("interval_weights", f"WITH {_MOVED}, {_SPANS} SELECT b.asset_id, b.market, b.date, round(sum(weight), 4) AS weight, count(*) AS spans FROM moved b JOIN spans p ON p.asset_id = b.asset_id AND b.date >= valid_from AND (valid_to IS NULL OR b.date <= valid_to) GROUP BY ALL")
def interval_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, f = shifted(spark, sf_dir)
    j = asof.interval_join(b.select(*KEYS), spans(f), ["asset_id"], "date", "valid_from", "valid_to")
    return j.groupBy(*KEYS).agg(F.round(F.sum("weight"), 4).alias("weight"), F.count(F.lit(1)).alias("spans"))


@register("interval_flag", f"WITH {_MOVED}, {_SPANS} SELECT b.asset_id, b.market, b.date, EXISTS (SELECT 1 FROM spans p WHERE p.asset_id = b.asset_id AND b.date >= valid_from AND b.date <= coalesce(valid_to, DATE '9999-12-31')) AS covered FROM moved b")
def interval_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, f = shifted(spark, sf_dir)
    return asof.covered(b.select(*KEYS), spans(f), ["asset_id"], "date", "valid_from", "valid_to")


@register("sessions_ago", f"""WITH {s.BARS}, d AS (SELECT market, date, row_number() OVER (PARTITION BY market ORDER BY date) AS i FROM (SELECT DISTINCT market, date FROM bars)), n AS (SELECT * FROM bars JOIN d USING (market, date))
SELECT a.asset_id, a.market, a.date, round(ln(a.amount / p.amount), 6) + 0.0 AS log_growth FROM n a LEFT JOIN n p ON p.asset_id = a.asset_id AND p.market = a.market AND p.i = a.i - 4""")
def sessions_ago(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = panel.bars(spark, sf_dir)
    out = asof.sessions_ago(b.select(*KEYS, "amount"), b, "amount", 4, "past")
    return rounded(out.withColumn("log_growth", F.log(F.col("amount") / F.col("past"))), KEYS, ["log_growth"])


# quality
@register("quality_rules", f"WITH {s.BARS} SELECT asset_id, market, count(*) AS bars, 0 AS nulls, 0 AS negative, count(*) FILTER (high < greatest(open, low, adj_close) OR low > least(open, high, adj_close)) AS bad_order, count(*) FILTER (volume = 0) AS no_volume, count(*) - count(DISTINCT date) AS repeats, min(date) AS first_date, max(date) AS last_date FROM bars GROUP BY ALL")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.violations(panel.bars(spark, sf_dir))


@register("gap_audit", f"WITH {s.BARS}, l AS (SELECT asset_id, market, min(date) AS a, max(date) AS z FROM bars GROUP BY ALL), d AS (SELECT DISTINCT market, date FROM bars) SELECT asset_id, market, date FROM l JOIN d USING (market) WHERE date BETWEEN a AND z AND NOT EXISTS (SELECT 1 FROM bars b WHERE b.asset_id = l.asset_id AND b.date = d.date)")
def gap_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.gaps(panel.bars(spark, sf_dir)).select("asset_id", "market", "date")


@register("stale_runs", f"WITH {s.BARS}, q AS (SELECT *, floor(volume / 20) AS lot FROM bars), c AS (SELECT *, CASE WHEN lot = lag(lot) OVER ({s.ASSET}) THEN 0 ELSE 1 END AS ch FROM q), r AS (SELECT *, sum(ch) OVER ({s.ASSET}) AS run FROM c) SELECT asset_id, market, min(date) AS \"start\", max(date) AS \"end\", count(*) AS length FROM r GROUP BY asset_id, market, run HAVING count(*) >= 3")
def stale_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.runs(panel.bars(spark, sf_dir).withColumn("lot", F.floor(F.col("volume") / 20)), "lot", 3)


@register("extreme_moves", f"""WITH {s.BARS}, m AS (SELECT *, {s.change('adj_close')} AS ret, datediff('day', lag(date) OVER ({s.ASSET}), date) AS days FROM bars), n AS (SELECT *, lead(ret) OVER ({s.ASSET}) AS nx FROM m)
SELECT asset_id, market, date, round(ret, 6) + 0.0 AS ret, CASE WHEN days > 14 THEN 'gap' WHEN ret * nx < 0 AND abs((1 + ret) * (1 + nx) - 1) <= 0.1 THEN 'reverted' ELSE 'move' END AS kind FROM n WHERE abs(ret) > 0.2""")
def extreme_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.extreme_moves(panel.bars(spark, sf_dir), 0.2).withColumn("ret", F.round("ret", 6) + F.lit(0.0))


@register("eligible_universe", f"WITH {s.BARS}, m AS (SELECT *, row_number() OVER ({s.ASSET}) AS seen, {s.roll('median', 'amount', 20)} AS md FROM bars) SELECT date, asset_id, market, seen, round(md, 4) AS median_amount FROM m WHERE seen >= 40 AND md >= 50000")
def eligible_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.eligible(panel.bars(spark, sf_dir), 40, 50_000).withColumn("median_amount", F.round("median_amount", 4))


@register("basis_repair", f"""WITH {s.BARS}, q AS (SELECT *, high / low AS ratio FROM bars), st AS (SELECT *, ratio / lag(ratio) OVER ({s.ASSET}) AS step FROM q),
ms AS (SELECT date FROM st WHERE greatest(step, 1 / step) > 1.5 GROUP BY date HAVING count(DISTINCT asset_id) >= 10)
SELECT asset_id, market, date, round(ln(product(CASE WHEN date IN (SELECT date FROM ms) AND greatest(step, 1 / step) > 1.5 THEN 1 / step ELSE 1.0 END) OVER ({s.ASSET} ROWS UNBOUNDED PRECEDING)), 6) + 0.0 AS log_correction FROM st""")
def basis_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = panel.bars(spark, sf_dir).withColumn("ratio", F.col("high") / F.col("low"))
    return rounded(quality.basis_repair(b, "ratio", 10, 1.5).withColumn("log_correction", F.log("correction")), KEYS, ["log_correction"])


# validation of return series: one long-short series per case
_CASES = f"""{core_queries._GROUPS},
ls AS (SELECT a.market, CASE a.factor_name WHEN 'momentum_5' THEN 0 ELSE 1 END * 2 + CASE a.horizon WHEN 1 THEN 0 ELSE 1 END AS case_no, a.date, a.m - b.m AS r FROM groups a JOIN groups b USING (date, market, factor_name, horizon, execution_lag) WHERE a.quantile = 5 AND b.quantile = 1)"""


def case_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    ls = evaluate.long_short(evaluate.bucket_returns(*core_queries.study_rows(spark, sf_dir)))
    no = F.when(F.col("factor_name") == "momentum_5", 0).otherwise(2) + F.when(F.col("horizon") == 1, 0).otherwise(1)
    return ls.select("market", no.cast("int").alias("case_no"), "date", F.col("long_short_return").alias("period_return"))


@register("vol_target", f"""WITH {_CASES}, v AS (SELECT *, CASE WHEN count(r) OVER p >= 20 THEN stddev_samp(r) OVER p END AS sd FROM ls WINDOW p AS (PARTITION BY market, case_no ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT market, case_no, date, round(coalesce(least(1.0, 0.1 / nullif(sd, 0)), 1), 6) AS exposure, round(r * coalesce(least(1.0, 0.1 / nullif(sd, 0)), 1), 6) + 0.0 AS scaled_return FROM v""")
def vol_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validate.vol_target(case_curves(spark, sf_dir), ["market", "case_no"], 0.1), ["market", "case_no", "date"], ["exposure", "scaled_return"])


@register("market_state_cap", f"""WITH {_CASES}, rr AS (SELECT *, {s.change('adj_close')} AS r0 FROM bars), bm AS (SELECT market, date, coalesce(avg(r0), 0) AS br FROM rr GROUP BY ALL),
be AS (SELECT *, product(1 + br) OVER (PARTITION BY market ORDER BY date ROWS UNBOUNDED PRECEDING) AS e FROM bm), mo AS (SELECT *, e / nullif(lag(e, 8) OVER (PARTITION BY market ORDER BY date), 0) - 1 AS mom FROM be),
cp AS (SELECT market, date, CASE WHEN lag(mom) OVER (PARTITION BY market ORDER BY date) < 0 THEN 0.5 ELSE 1.0 END AS cap FROM mo)
SELECT ls.market, case_no, ls.date, coalesce(cap, 1.0) AS cap, round(r * coalesce(cap, 1.0), 6) + 0.0 AS scaled_return FROM ls LEFT JOIN cp USING (market, date)""")
def market_state_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = portfolio.benchmark_curve(panel.bars(spark, sf_dir))
    return rounded(validate.market_state_cap(case_curves(spark, sf_dir), bench, 8, 0.5), ["market", "case_no", "date"], ["cap", "scaled_return"])


_FOLDS = """n AS (SELECT market, date, row_number() OVER (PARTITION BY market ORDER BY date) AS i FROM (SELECT DISTINCT market, date FROM ls)), sz AS (SELECT market, max(i) AS n FROM n GROUP BY ALL),
fo AS (SELECT market, CAST(f AS INTEGER) AS fold, f * 26 + 1 AS a, f * 26 + 104 AS b, f * 26 + 105 AS c, f * 26 + 130 AS d FROM (SELECT market, n, unnest(range(0, CAST(floor((n - 130) / 26.0) AS BIGINT) + 1)) AS f FROM sz WHERE n >= 130)),
folds AS (SELECT fo.market, fold, na.date AS train_start, nb.date AS train_end, nc.date AS test_start, nd.date AS test_end FROM fo JOIN n na ON na.market = fo.market AND na.i = a JOIN n nb ON nb.market = fo.market AND nb.i = b JOIN n nc ON nc.market = fo.market AND nc.i = c JOIN n nd ON nd.market = fo.market AND nd.i = d)"""


@register("rolling_folds", f"WITH {_CASES}, {_FOLDS} SELECT * FROM folds")
def rolling_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.rolling_folds(case_curves(spark, sf_dir), 104, 26, ["market"])


@register("walk_forward_choice", f"""WITH {_CASES}, {_FOLDS}, tr AS (SELECT ls.market, fold, case_no, round(avg(r) / nullif(stddev_pop(r), 0), 10) AS sc FROM ls JOIN folds USING (market) WHERE ls.date BETWEEN train_start AND train_end GROUP BY ALL),
bs AS (SELECT *, row_number() OVER (PARTITION BY market, fold ORDER BY sc DESC, case_no) AS k FROM tr WHERE sc IS NOT NULL),
te AS (SELECT ls.market, fold, case_no, product(1 + r) - 1 AS tret, count(*) AS np FROM ls JOIN folds USING (market) WHERE ls.date BETWEEN test_start AND test_end GROUP BY ALL)
SELECT bs.market, bs.fold, CAST(bs.case_no AS INTEGER) AS case_no, round(sc, 6) + 0.0 AS train_score, round(tret, 6) + 0.0 AS test_return, np AS test_periods FROM bs LEFT JOIN te USING (market, fold, case_no) WHERE k = 1""")
def walk_forward_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    curves = case_curves(spark, sf_dir)
    out = validate.walk_forward_choice(curves, validate.rolling_folds(curves, 104, 26, ["market"]), ["market"], "case_no")
    return out.select("market", "fold", F.col("case_no").cast("int").alias("case_no"), (F.round("train_score", 6) + F.lit(0.0)).alias("train_score"), (F.round("test_return", 6) + F.lit(0.0)).alias("test_return"), "test_periods")


@register("pair_correlations", f"WITH {_CASES} SELECT a.market, CAST(a.case_no AS INTEGER) AS case_no, CAST(b.case_no AS INTEGER) AS other, round(corr(a.r, b.r), 6) + 0.0 AS correlation, count(*) AS n FROM ls a JOIN ls b ON a.market = b.market AND a.date = b.date AND a.case_no < b.case_no GROUP BY ALL")
def pair_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = validate.pair_correlations(case_curves(spark, sf_dir), ["market"], "case_no")
    return out.withColumn("correlation", F.round("correlation", 6) + F.lit(0.0))


@register("block_bootstrap", f"""WITH {_CASES}, pr AS (SELECT a.market, a.date, a.r AS x, b.r AS y FROM ls a JOIN ls b USING (market, date) WHERE a.case_no = 0 AND b.case_no = 2),
bl AS (SELECT market, block, sum(x - y) AS d, count(*) AS n FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY market ORDER BY date) - 1) / 13.0) AS BIGINT) AS block FROM pr) GROUP BY ALL),
sz AS (SELECT market, count(*) AS k FROM bl GROUP BY ALL), pl AS (SELECT market, k, dr, unnest(range(1, k + 1)) AS pk FROM (SELECT market, k, unnest(range(1, 101)) AS dr FROM sz)),
ch AS (SELECT market, dr, CAST(('0x' || substr(md5('7/' || market || '/' || dr || '/' || pk), 1, 8)) AS BIGINT) % k AS block FROM pl)
SELECT market, CAST(dr AS INTEGER) AS draw, round(sum(d) / sum(n), 7) + 0.0 AS mean_difference FROM ch JOIN bl USING (market, block) GROUP BY ALL""")
def block_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = case_curves(spark, sf_dir)
    pair = c.where("case_no = 0").select("market", "date", F.col("period_return").alias("x")).join(c.where("case_no = 2").select("market", "date", F.col("period_return").alias("y")), ["market", "date"])
    out = validate.block_bootstrap(pair, ["market"], "x", "y", 13, 100, 7)
    return out.withColumn("mean_difference", F.round("mean_difference", 7) + F.lit(0.0))


@register("selection_jaccard", f"""WITH {portfolio_queries._MOM}, u AS (SELECT date, market, asset_id, factor_value AS x, 0 AS case_no FROM v UNION ALL SELECT date, market, asset_id, -factor_value, 1 FROM v UNION ALL SELECT date, market, asset_id, abs(factor_value), 2 FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY date, market, case_no ORDER BY x DESC, asset_id) AS k FROM u), t AS (SELECT date, market, asset_id, case_no FROM r WHERE k <= 3), z AS (SELECT case_no, count(*) AS n FROM t GROUP BY ALL),
p AS (SELECT a.case_no, b.case_no AS other, count(*) AS shared FROM t a JOIN t b USING (date, market, asset_id) WHERE a.case_no < b.case_no GROUP BY ALL)
SELECT CAST(p.case_no AS INTEGER) AS case_no, CAST(other AS INTEGER) AS other, shared, round(shared / CAST(z.n + y.n - shared AS DOUBLE), 6) AS jaccard FROM p JOIN z ON z.case_no = p.case_no JOIN z y ON y.case_no = p.other""")
def selection_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, f = portfolio_queries.momentum(spark, sf_dir)
    v = F.col("factor_value")
    cases = f.select("date", "market", "asset_id", F.inline(F.array(*[F.struct(F.lit(i).alias("case_no"), x.alias("factor_value")) for i, x in enumerate((v, -v, F.abs(v)))])))
    top = portfolio.select_top(cases, 3, ("date", "market", "case_no"))
    return validate.jaccard(top, ["date", "market", "asset_id"], "case_no").withColumn("jaccard", F.round("jaccard", 6))


_M = f"""{s.BARS}, r0 AS (SELECT *, {s.change('adj_close')} AS r FROM bars), r1 AS (SELECT *, CASE WHEN count(r) {_X} >= 5 THEN median(r) {_X} END AS m FROM r0), r2 AS (SELECT *, CASE WHEN r IS NOT NULL AND m IS NOT NULL THEN r END AS pr, CASE WHEN r IS NOT NULL AND m IS NOT NULL THEN m END AS pm FROM r1),"""
_W = "OVER (PARTITION BY asset_id ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"


@register("market_residual", f"""WITH {_M} r3 AS (SELECT *, CASE WHEN count(pr) {_W} >= 40 AND min(pm) {_W} < max(pm) {_W} THEN covar_samp(pr, pm) {_W} / var_samp(pm) {_W} END AS beta, CASE WHEN count(pr) {_W} >= 40 THEN avg(pr) {_W} END AS mr, CASE WHEN count(pm) {_W} >= 40 THEN avg(pm) {_W} END AS mm FROM r2),
r4 AS (SELECT *, r - lag(mr - beta * mm) OVER ({s.ASSET}) - lag(beta) OVER ({s.ASSET}) * m AS res FROM r3)
SELECT asset_id, market, date, round(beta, 5) + 0.0 AS beta, round(res, 6) + 0.0 AS residual, round(-{s.roll('stddev_pop', 'res', 30, 20)}, 6) + 0.0 AS idio_vol_low FROM r4""")
def market_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beta to the cross-section's median return, residuals of the model known one bar before, and their deviation."""
    r, m = F.col("r"), F.col("m")
    df = w.steps(
        panel.bars(spark, sf_dir),
        {"r": w.change("adj_close")},
        {"m": F.when(F.count("r").over(w.cross()) >= 5, F.median("r").over(w.cross()))},
        {"pr": F.when(r.isNotNull() & m.isNotNull(), r), "pm": F.when(r.isNotNull() & m.isNotNull(), m)},
        {"beta": w.pair_roll(lambda a, b: F.covar_samp(a, b) , "pr", "pm", 60, 40) / F.nullif(w.roll(F.var_samp, "pm", 60, 40), F.lit(0.0)), "mr": w.mean("pr", 60, 40), "mm": w.mean("pm", 60, 40)},
        {"residual": r - w.lag(F.col("mr") - F.col("beta") * F.col("mm")) - w.lag("beta") * m},
        {"idio_vol_low": -w.std("residual", 30, 20)},
    )
    return df.select(*KEYS, (F.round("beta", 5) + F.lit(0.0)).alias("beta"), (F.round("residual", 6) + F.lit(0.0)).alias("residual"), (F.round("idio_vol_low", 6) + F.lit(0.0)).alias("idio_vol_low"))


@register("liquidity_capacity", s.final([
    {"paid": "CASE WHEN amount > 0 THEN amount END", "ret": s.change("adj_close")},
    {"am": "abs(ret) / paid", "base": s.roll("median", "paid", 60, shift=1)},
    {"recent": s.roll("avg", "am", 5), "prior": s.roll("avg", "am", 60, shift=5), "above": "CASE WHEN base IS NOT NULL AND paid IS NOT NULL THEN CASE WHEN paid > base THEN 1.0 ELSE 0.0 END END", "s1": s.roll("sum", "paid", 20), "s2": s.roll("sum", "paid * paid", 20)},
    {"amihud_improvement": "ln(prior / nullif(recent, 0))", "participation_breadth": s.roll("avg", "above", 20), "distribution_quality": "1 - s2 / (s1 * s1)"},
], ["amihud_improvement", "participation_breadth", "distribution_quality"]))
def liquidity_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impact now against before, share of sessions above the prior median amount, evenness of amounts."""
    df = w.steps(
        panel.bars(spark, sf_dir),
        {"paid": F.when(F.col("amount") > 0, F.col("amount")), "ret": w.change("adj_close")},
        {"am": w.div(F.abs("ret"), "paid"), "base": w.middle("paid", 60, shift=1)},
        {"recent": w.mean("am", 5), "prior": w.mean("am", 60, shift=5), "above": F.when(F.col("base").isNotNull() & F.col("paid").isNotNull(), (F.col("paid") > F.col("base")).cast("double")), "s1": w.total("paid", 20), "s2": w.total(F.col("paid") * F.col("paid"), 20)},
        {"amihud_improvement": F.log(w.div("prior", "recent")), "participation_breadth": w.mean("above", 20), "distribution_quality": 1 - w.div("s2", F.col("s1") * F.col("s1"))},
    )
    return rounded(df, KEYS, ["amihud_improvement", "participation_breadth", "distribution_quality"])
