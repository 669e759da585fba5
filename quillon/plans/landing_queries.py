"""Landing and maintenance of tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import panel
from ..operators import evaluate, labels, portfolio
from ..sources import store
from . import core_queries
from . import sqltext as s
from .registry import register

KEYS = ["asset_id", "market", "date"]


@register("column_mapping", "SELECT o_orderkey AS order_id, CAST(o_custkey AS VARCHAR) AS customer, CAST(strptime(strftime(o_orderdate, '%Y%m%d'), '%Y%m%d') AS DATE) AS day, round(o_totalprice, 2) AS total, TRY_CAST(o_orderpriority AS DOUBLE) AS priority_number FROM orders")
def column_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = panel.read(spark, sf_dir, "orders").withColumns({"day_text": F.date_format("o_orderdate", "yyyyMMdd"), "total_text": F.round("o_totalprice", 2)})
    return store.map_columns(raw, {"order_id": ("o_orderkey", "bigint"), "customer": ("o_custkey", "string"), "day": ("day_text", "date"), "total": ("total_text", "double"), "priority_number": ("o_orderpriority", "double")})


@register("keep_last_upsert", """WITH o AS (SELECT o_custkey AS customer, CAST(o_orderdate AS DATE) AS day, max(o_orderkey) AS seq, max_by(o_totalprice, o_orderkey) AS total FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY ALL),
n AS (SELECT o_custkey AS customer, CAST(o_orderdate AS DATE) AS day, max(o_orderkey) AS seq, max_by(o_totalprice, o_orderkey) AS total FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL)
SELECT coalesce(n.customer, o.customer) AS customer, coalesce(n.day, o.day) AS day, coalesce(n.seq, o.seq) AS seq, round(coalesce(n.total, o.total), 2) AS total FROM o FULL JOIN n USING (customer, day)""")
def keep_last_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = panel.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("total"))
    merged = store.keep_last(o.where("seq % 3 <> 0"), o.where("seq % 3 = 0"), ["customer", "day"])
    return merged.select("customer", "day", "seq", F.round("total", 2).alias("total"))


@register("adjusted_close", f"WITH {s.BARS}, f AS (SELECT asset_id, date, 1 + asset_id / 100.0 AS factor FROM bars), j AS (SELECT b.*, f.factor FROM bars b LEFT JOIN f USING (asset_id, date)) SELECT asset_id, market, date, round(adj_close * factor, 6) AS adj_close, true AS adjusted FROM j WHERE (SELECT count(*) FROM j WHERE factor IS NULL) = 0")
def adjusted_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = panel.bars(spark, sf_dir)
    f = b.select("asset_id", "date", (1 + F.col("asset_id") / 100.0).alias("factor"))
    return store.attach_adjusted(b, f, ["asset_id", "date"]).select(*KEYS, F.round("adj_close", 6).alias("adj_close"), "adjusted")


@register("calendar_differences", f"WITH {s.BARS}, a AS (SELECT DISTINCT date FROM bars), b AS (SELECT DISTINCT CAST(date_trunc('week', o_orderdate) AS DATE) AS date FROM orders) SELECT date, 'first' AS only_in FROM a WHERE date NOT IN (SELECT date FROM b) UNION ALL SELECT date, 'second' FROM b WHERE date NOT IN (SELECT date FROM a)")
def calendar_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the bars against the weeks in which anything was ordered."""
    weeks = panel.read(spark, sf_dir, "orders").select(F.date_trunc("week", "o_orderdate").cast("date").alias("date"))
    return store.calendar_differences(panel.bars(spark, sf_dir), weeks)


@register("missing_sessions", f"WITH {s.BARS}, h AS (SELECT DISTINCT market, date FROM bars) SELECT market, date FROM (SELECT DISTINCT market FROM h) CROSS JOIN (SELECT DISTINCT date FROM h) EXCEPT SELECT market, date FROM h")
def missing_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every market against the calendar of all bars."""
    return store.missing_sessions(panel.bars(spark, sf_dir))


@register("available_from", f"WITH {s.BARS}, d AS (SELECT date, lead(date) OVER (ORDER BY date) AS nx FROM (SELECT DISTINCT date FROM bars)) SELECT asset_id, market, date, coalesce(CAST(nx AS VARCHAR), '') AS available_date FROM bars JOIN d USING (date)")
def available_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = panel.bars(spark, sf_dir)
    return store.available_from(b.select(*KEYS), b, "date").select(*KEYS, F.coalesce(F.col("available_date").cast("string"), F.lit("")).alias("available_date"))


@register("content_fingerprint")
def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.fingerprint(panel.read(spark, sf_dir, "lineitem"))


@register("rebalance_dates", f"WITH {s.BARS}, d AS (SELECT market, date, row_number() OVER (PARTITION BY market ORDER BY date) - 1 AS i FROM (SELECT DISTINCT market, date FROM bars)) SELECT market, date FROM d WHERE i >= 2 AND (i - 2) % 4 = 0")
def rebalance_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = labels.sessions(panel.bars(spark, sf_dir)).select("market", "date")
    return portfolio.every_kth_date(days, 4, 2, ("market",))


_IC_T = core_queries._IC


@register("false_discovery", f"""WITH {_IC_T}, p AS (SELECT market, factor_name, horizon, date, exp(-abs(round(rank_ic, 9)) * sqrt(n)) AS p FROM ic0 WHERE rank_ic IS NOT NULL),
r AS (SELECT *, count(*) OVER w0 AS m, row_number() OVER (PARTITION BY market, factor_name, horizon ORDER BY p, date) AS k FROM p WINDOW w0 AS (PARTITION BY market, factor_name, horizon))
SELECT market, factor_name, horizon, date, round(least(1.0, min(p * m / k) OVER (PARTITION BY market, factor_name, horizon ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS bh_p_value, round(least(1.0, p * m), 6) AS bonferroni_p_value FROM r""")
def false_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step-up adjustment over a bound of each date's p-value, which SQL can state as well."""
    ic = evaluate.correlations(*core_queries.study_rows(spark, sf_dir), p_values=False).where("rank_ic is not null")
    p = F.exp(-F.abs(F.round("rank_ic", 9)) * F.sqrt("count"))
    out = evaluate.benjamini_hochberg(ic.withColumn("p", p), "p", ["market", "factor_name", "horizon"], ["date"])
    return out.select("market", "factor_name", "horizon", "date", F.round("bh_p_value", 6).alias("bh_p_value"), F.round("bonferroni_p_value", 6).alias("bonferroni_p_value"))


@register("false_discovery_ic")
def false_discovery_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step-up adjustment of the p-values of each date's rank correlation; the normal distribution is beyond SQL."""
    ic = evaluate.correlations(*core_queries.study_rows(spark, sf_dir)).where("rank_ic_p_value is not null")
    out = evaluate.benjamini_hochberg(ic, "rank_ic_p_value", ["market", "factor_name", "horizon"], ["date"])
    return out.select("market", "factor_name", "horizon", "date", "rank_ic_p_value", "bh_p_value", "bonferroni_p_value")
