"""Purged combinations, lattice neighbours and greedy duplicates, with their SQL."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import panel
from ..functions import windows as w
from ..operators import portfolio, robustness
from . import portfolio_queries, research_queries
from . import sqltext as s
from .registry import register, rounded

_CASES = research_queries._CASES
GROUPS, CHOSEN, PURGE, EMBARGO = 6, 2, 2, 3
_SPLITS = ", ".join(f"({i}, {list(c)})" for i, c in enumerate(itertools.combinations(range(GROUPS), CHOSEN), start=1))
_COMBINED = f"""{_CASES}, dn AS (SELECT market, date, row_number() OVER (PARTITION BY market ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY market) AS n FROM (SELECT DISTINCT market, date FROM ls)),
dg AS (SELECT market, date, i, CAST(CASE WHEN i < (n % {GROUPS}) * (n // {GROUPS} + 1) THEN i // (n // {GROUPS} + 1) ELSE n % {GROUPS} + (i - (n % {GROUPS}) * (n // {GROUPS} + 1)) // (n // {GROUPS}) END AS INTEGER) AS g FROM dn WHERE n >= {GROUPS}),
sp(split, tested) AS (VALUES {_SPLITS}), du AS (SELECT dg.*, split, list_contains(tested, g) AS t FROM dg, sp),
co AS (SELECT market, split, date, g, CASE WHEN t THEN 'test' WHEN max(CAST(t AS INTEGER)) OVER (PARTITION BY market, split ORDER BY i ROWS BETWEEN {EMBARGO} PRECEDING AND {PURGE} FOLLOWING) = 1 THEN 'purged' ELSE 'train' END AS role FROM du)"""


def combined(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    curves = research_queries.case_curves(spark, sf_dir)
    return curves, robustness.purged_combinations(curves, ["market"], GROUPS, CHOSEN, PURGE, EMBARGO)


@register("purged_combinations", f"WITH {_COMBINED} SELECT market, CAST(split AS INTEGER) AS split, date, g AS \"group\", role FROM co")
def purged_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combined(spark, sf_dir)[1].select("market", "split", "date", "group", "role")


_EVALUATED = f"""{_COMBINED}, ev AS (SELECT co.market, case_no, split, count(*) AS observations, avg(r) AS m, stddev_samp(r) AS sd FROM co JOIN ls USING (market, date) WHERE role = 'test' GROUP BY ALL),
es AS (SELECT *, coalesce(CASE WHEN sd > 1e-7 * abs(m) THEN m / sd * sqrt(52) END, 0) AS sharpe FROM ev)"""


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robustness.evaluate_combinations(*combined(spark, sf_dir), ["market"], "case_no", 52.0)


@register("combination_scores", f"WITH {_EVALUATED} SELECT market, CAST(case_no AS INTEGER) AS case_no, CAST(split AS INTEGER) AS split, observations, round(m, 6) + 0.0 AS mean_return, round(sharpe, 5) + 0.0 AS sharpe, m > 0 AS positive FROM es")
def combination_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluated(spark, sf_dir)
    return out.select("market", "case_no", "split", "observations", (F.round("mean_return", 6) + F.lit(0.0)).alias("mean_return"), (F.round("sharpe", 5) + F.lit(0.0)).alias("sharpe"), "positive")


@register("combination_verdicts", f"""WITH {_EVALUATED}, ve AS (SELECT market, case_no, count(*) AS splits, avg(CAST(m > 0 AS DOUBLE)) AS positive_rate, quantile_cont(m, 0.1) AS p10, median(sharpe) AS ms FROM es GROUP BY ALL)
SELECT market, CAST(case_no AS INTEGER) AS case_no, splits, positive_rate >= 0.5 AND p10 >= -0.01 AS passes, round(positive_rate, 6) AS positive_rate, round(p10, 6) + 0.0 AS p10_mean_return, round(ms, 5) + 0.0 AS median_sharpe FROM ve""")
def combination_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = robustness.combination_verdicts(evaluated(spark, sf_dir), ["market"], "case_no", 0.5, -0.01)
    return out.select("market", "case_no", "splits", "passes", F.round("positive_rate", 6).alias("positive_rate"), (F.round("p10_mean_return", 6) + F.lit(0.0)).alias("p10_mean_return"), (F.round("median_sharpe", 5) + F.lit(0.0)).alias("median_sharpe"))


@register("combination_paths", f"""WITH {_COMBINED}, tr AS (SELECT co.market, split, case_no, round(avg(r) / nullif(stddev_pop(r), 0), 10) AS score FROM co JOIN ls USING (market, date) WHERE role = 'train' GROUP BY ALL),
pk AS (SELECT *, row_number() OVER (PARTITION BY market, split ORDER BY score DESC, case_no) AS k FROM tr WHERE score IS NOT NULL),
nu AS (SELECT *, row_number() OVER (PARTITION BY market, g ORDER BY split) AS path FROM (SELECT DISTINCT market, split, g FROM co WHERE role = 'test')),
ch AS (SELECT co.market, path, r, ls.case_no FROM co JOIN ls USING (market, date) JOIN pk ON pk.market = co.market AND pk.split = co.split AND pk.case_no = ls.case_no AND pk.k = 1 JOIN nu ON nu.market = co.market AND nu.split = co.split AND nu.g = co.g WHERE role = 'test')
SELECT market, CAST(path AS INTEGER) AS path, count(*) AS periods, round(product(1 + r) - 1, 6) + 0.0 AS path_return, count(DISTINCT case_no) AS cases FROM ch GROUP BY market, path""")
def combination_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = robustness.combination_paths(*combined(spark, sf_dir), ["market"], "case_no")
    return out.withColumn("path_return", F.round("path_return", 6) + F.lit(0.0))


@register("deflated_sharpe")
def deflated_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(robustness.deflated_sharpe(research_queries.case_curves(spark, sf_dir), ["market"], "case_no"), ["market", "case_no", "n", "trials"], ["sharpe", "hurdle", "dsr"])


# a lattice of lookbacks and holding times; a case's metric is the mean product of momentum and the return that follows
LOOKBACKS, HOLDS = (2, 3, 5, 8), (1, 2, 4)
_LATTICE = s.chain([
    {f"m{a}": f"adj_close / nullif({s.lag('adj_close', a)}, 0) - 1" for a in LOOKBACKS} | {f"h{b}": f"lead(adj_close, {b}) OVER ({s.ASSET}) / nullif(adj_close, 0) - 1" for b in HOLDS},
]) + f""",
la AS ({' UNION ALL '.join(f"SELECT market, {a} AS lookback, {b} AS hold, m{a} * h{b} AS x FROM last" for a in LOOKBACKS for b in HOLDS)}),
ce AS (SELECT market, lookback, hold, round(avg(x), 10) AS m FROM la WHERE x IS NOT NULL GROUP BY ALL),
rk AS (SELECT *, dense_rank() OVER (PARTITION BY market ORDER BY lookback) AS a, dense_rank() OVER (PARTITION BY market ORDER BY hold) AS b, row_number() OVER (PARTITION BY market ORDER BY m DESC, lookback, hold) = 1 AS best, CASE WHEN m > 0 THEN m * 0.75 ELSE m END AS lim FROM ce),
nb AS (SELECT r.market, r.lookback, r.hold, r.m, r.best, count(o.m) AS neighbours, count(CASE WHEN o.m >= r.lim THEN 1 END) AS passing FROM rk r LEFT JOIN rk o ON o.market = r.market AND abs(o.a - r.a) <= 1 AND abs(o.b - r.b) <= 1 AND (o.a <> r.a OR o.b <> r.b) GROUP BY ALL)
SELECT market, CAST(lookback AS INTEGER) AS lookback, CAST(hold AS INTEGER) AS hold, best, neighbours, passing, passing >= 2 AS stable, round(m, 6) + 0.0 AS metric_mean FROM nb"""  # fmt: skip


@register("lattice_neighbours", _LATTICE)
def lattice_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("adj_close")
    b = panel.bars(spark, sf_dir).withColumns({f"m{a}": w.change(p, a) for a in LOOKBACKS} | {f"h{h}": w.div(F.lead(p, h).over(w.by_asset()), p) - 1 for h in HOLDS})
    rows = b.select("market", F.inline(F.array(*[F.struct(F.lit(a).alias("lookback"), F.lit(h).alias("hold"), (F.col(f"m{a}") * F.col(f"h{h}")).alias("x")) for a in LOOKBACKS for h in HOLDS])))
    cells = rows.groupBy("market", "lookback", "hold").agg(F.round(F.avg("x"), 10).alias("metric"))
    out = robustness.lattice_neighbours(cells, ["market"], ["lookback", "hold"], "metric")
    return out.select("market", "lookback", "hold", "best", "neighbours", "passing", "stable", (F.round("metric_mean", 6) + F.lit(0.0)).alias("metric_mean"))


def _greedy(ranked: str, close: str, first: str) -> str:
    """A fold over ranks: ``ranked`` (market, case_no, k), ``close`` (market, k, place, similarity); ``first`` orders a candidate's kept rivals."""
    return f"""rv AS (SELECT rk.market, rk.k, rk.case_no, coalesce(list({{'place': c.place, 'similarity': c.similarity}} ORDER BY {first}) FILTER (c.place IS NOT NULL), []) AS rivals FROM {ranked} rk LEFT JOIN {close} c ON c.market = rk.market AND c.k = rk.k GROUP BY ALL),
fo(market, k, kept, rival) AS (SELECT market, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS STRUCT(place BIGINT, similarity DOUBLE)) FROM (SELECT DISTINCT market FROM rv)
  UNION ALL SELECT market, k, CASE WHEN len(near) > 0 THEN kept ELSE list_append(kept, k) END, near[1] FROM (SELECT fo.market, rv.k, fo.kept, list_filter(rv.rivals, lambda x: list_contains(fo.kept, x.place)) AS near FROM fo JOIN rv ON rv.market = fo.market AND rv.k = fo.k + 1)),
vd AS (SELECT rv.market, rv.case_no, fo.rival IS NULL AS kept, fo.rival.place AS place, fo.rival.similarity AS similarity FROM fo JOIN rv ON rv.market = fo.market AND rv.k = fo.k)
SELECT vd.market, CAST(vd.case_no AS INTEGER) AS case_no, kept, CAST(coalesce(o.case_no, -1) AS INTEGER) AS duplicate_of, round(coalesce(similarity, 0), 5) AS similarity FROM vd LEFT JOIN rv o ON o.market = vd.market AND o.k = vd.place"""


_BY_RETURN = f"""WITH RECURSIVE {_CASES}, sc AS (SELECT market, case_no, round(avg(r) / nullif(stddev_pop(r), 0), 8) AS score FROM ls GROUP BY ALL), rk AS (SELECT market, case_no, row_number() OVER (PARTITION BY market ORDER BY score DESC NULLS LAST, case_no) AS k FROM sc),
pc AS (SELECT a.market, a.case_no AS x, b.case_no AS y, corr(a.r, b.r) AS similarity FROM ls a JOIN ls b ON a.market = b.market AND a.date = b.date AND a.case_no < b.case_no GROUP BY ALL HAVING count(*) >= 3),
cl AS (SELECT pc.market, greatest(a.k, b.k) AS k, least(a.k, b.k) AS place, similarity FROM pc JOIN rk a ON a.market = pc.market AND a.case_no = x JOIN rk b ON b.market = pc.market AND b.case_no = y WHERE round(similarity, 6) >= 0.25), """


def _verdicts(df: DataFrame) -> DataFrame:
    return df.select("market", F.col("case_no").cast("int").alias("case_no"), "kept", F.coalesce("duplicate_of", F.lit(-1)).cast("int").alias("duplicate_of"), F.round(F.coalesce("similarity", F.lit(0.0)), 5).alias("similarity"))


@register("duplicate_returns", _BY_RETURN + _greedy("rk", "cl", "c.place"))
def duplicate_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    curves = research_queries.case_curves(spark, sf_dir)
    r = F.col("period_return")
    scored = curves.groupBy("market", "case_no").agg(F.round(w.div(F.avg(r), F.stddev_pop(r)), 8).alias("score"))
    pairs = robustness.correlation_pairs(curves, ["market"], "case_no").withColumn("similarity", F.round("similarity", 6))
    return _verdicts(robustness.greedy_duplicates(scored, pairs, ["market"], "case_no", [F.desc_nulls_last("score")], 0.25))


N_VARIANTS = 7
_BY_SIGNAL = f"""WITH RECURSIVE {portfolio_queries._MOM}, va AS (SELECT date, market, asset_id, factor_value * (1 + 0.3 * (hash_no % (2 + case_no))) AS x, case_no FROM (SELECT v.*, (asset_id * 7 + CAST(datediff('day', DATE '1990-01-01', date) AS BIGINT)) % 11 AS hash_no FROM v), range({N_VARIANTS}) t(case_no)),
tp AS (SELECT market, date, asset_id, case_no FROM (SELECT *, row_number() OVER (PARTITION BY date, market, case_no ORDER BY x DESC, asset_id) AS k FROM va) WHERE k <= 2), sz AS (SELECT market, case_no, count(*) AS n FROM tp GROUP BY ALL),
rk AS (SELECT market, case_no, row_number() OVER (PARTITION BY market ORDER BY (case_no * 3) % {N_VARIANTS}, case_no) AS k FROM sz),
pc AS (SELECT a.market, a.case_no AS x, b.case_no AS y, count(*) AS shared FROM tp a JOIN tp b ON a.market = b.market AND a.date = b.date AND a.asset_id = b.asset_id AND a.case_no < b.case_no GROUP BY ALL),
cl AS (SELECT pc.market, greatest(a.k, b.k) AS k, least(a.k, b.k) AS place, shared / CAST(s.n + z.n - shared AS DOUBLE) AS similarity FROM pc JOIN rk a ON a.market = pc.market AND a.case_no = x JOIN rk b ON b.market = pc.market AND b.case_no = y JOIN sz s ON s.market = pc.market AND s.case_no = x JOIN sz z ON z.market = pc.market AND z.case_no = y WHERE shared / CAST(s.n + z.n - shared AS DOUBLE) >= 0.6), """


@register("duplicate_signals", _BY_SIGNAL + _greedy("rk", "cl", "c.similarity DESC, c.place"))
def duplicate_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, f = portfolio_queries.momentum(spark, sf_dir)
    mixed = (F.col("asset_id") * 7 + F.datediff("date", F.lit("1990-01-01").cast("date"))) % 11
    cases = f.where("factor_value is not null").withColumn("case_no", F.explode(F.array(*[F.lit(i) for i in range(N_VARIANTS)])))
    cases = cases.withColumn("factor_value", F.col("factor_value") * (1 + F.lit(0.3) * (mixed % (2 + F.col("case_no")))))
    top = portfolio.select_top(cases.select("date", "market", "asset_id", "case_no", "factor_value"), 2, ("date", "market", "case_no"))
    pairs = robustness.overlap_pairs(top, ["market"], "case_no", ["date", "asset_id"], least=1)
    each = top.select("market", "case_no").distinct()
    return _verdicts(robustness.greedy_duplicates(each, pairs, ["market"], "case_no", [(F.col("case_no") * 3) % N_VARIANTS], 0.6, most_similar=True))
