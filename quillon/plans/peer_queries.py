"""Peer mappings, edges and co-movement, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import panel
from ..functions import windows as w
from ..operators import peers
from ..sources import store
from . import sqltext as s
from .registry import register, rounded

# quarterly snapshots: an asset belongs to the group of the part it delivered most of; a few are listed later in the quarter
_SNAPS = """sp AS (SELECT CAST(date_trunc('quarter', l_shipdate) AS DATE) AS snapshot, l_suppkey AS asset_id, CASE WHEN arg_max(l_partkey, l_partkey * 100 + l_linenumber) % 7 <> 0 THEN ' g' || CAST(arg_max(l_partkey, l_partkey * 100 + l_linenumber) % 7 AS VARCHAR) END AS peer_id FROM lineitem GROUP BY ALL),
ls AS (SELECT *, CASE WHEN asset_id % 5 = 0 THEN CAST(snapshot + CAST(30 * (asset_id % 4) AS INTEGER) AS DATE) END AS list_date FROM sp)"""


@register("peer_mapping_history", f"""WITH {_SNAPS}, nx AS (SELECT snapshot, lead(snapshot) OVER (ORDER BY snapshot) AS nxt FROM (SELECT DISTINCT snapshot FROM ls)),
mp AS (SELECT asset_id, upper(trim(peer_id)) AS peer_id, greatest(snapshot, coalesce(list_date, snapshot)) AS valid_from, CAST(nxt - 1 AS DATE) AS valid_to, snapshot AS known_from FROM ls JOIN nx USING (snapshot) WHERE peer_id IS NOT NULL)
SELECT asset_id, peer_id, valid_from, coalesce(CAST(valid_to AS VARCHAR), '') AS valid_to, known_from FROM mp WHERE valid_to IS NULL OR valid_from <= valid_to""")
def peer_mapping_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = panel.read(spark, sf_dir, "lineitem")
    group = F.max_by("l_partkey", F.col("l_partkey") * 100 + F.col("l_linenumber")) % 7
    rows = lines.groupBy(F.date_trunc("quarter", "l_shipdate").cast("date").alias("snapshot"), F.col("l_suppkey").alias("asset_id")).agg(F.when(group != 0, F.concat(F.lit(" g"), group.cast("string"))).alias("peer_id"))
    listed = F.when(F.col("asset_id") % 5 == 0, F.date_add("snapshot", (30 * (F.col("asset_id") % 4)).cast("int")))
    out = peers.mapping_history(rows.withColumn("list_date", listed))
    return out.select("asset_id", "peer_id", "valid_from", F.coalesce(F.col("valid_to").cast("string"), F.lit("")).alias("valid_to"), "known_from")


# edges to the next four assets of the market for half a year from each quarter of their bars on (so they overlap); some stay open
_EDGES = f"""{s.BARS}, sz AS (SELECT asset_id, market, row_number() OVER (PARTITION BY market ORDER BY asset_id) AS i, count(*) OVER (PARTITION BY market) AS n FROM (SELECT DISTINCT asset_id, market FROM bars)),
pr AS (SELECT a.asset_id, b.asset_id AS peer_asset_id FROM sz a JOIN sz b ON a.market = b.market AND ((b.i - a.i + a.n) % a.n) BETWEEN 1 AND 4),
qs AS (SELECT DISTINCT asset_id, CAST(date_trunc('quarter', date) AS DATE) AS q FROM bars), ed AS (SELECT qs.asset_id, peer_asset_id, q AS valid_from, CASE WHEN (qs.asset_id + month(q)) % 9 <> 0 THEN CAST(q + INTERVAL 6 MONTH AS DATE) END AS valid_to FROM qs JOIN pr USING (asset_id)),
mv AS (SELECT asset_id, market, date, {s.change('adj_close', 3)} AS v FROM bars),
pv AS (SELECT DISTINCT f.date, f.asset_id, f.market, f.v, p.asset_id AS peer, p.v AS pv FROM mv f JOIN ed ON ed.asset_id = f.asset_id AND f.date >= ed.valid_from AND (ed.valid_to IS NULL OR f.date <= ed.valid_to) JOIN mv p ON p.asset_id = ed.peer_asset_id AND p.date = f.date AND p.market = f.market WHERE f.v IS NOT NULL AND p.v IS NOT NULL)"""


def edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, dict]:
    """Three-bar returns of the assets, edges between assets of a market, and a bound of the dates and partitions for both."""
    lines = panel.read(spark, sf_dir, "lineitem")
    quarter = F.date_trunc("quarter", F.date_trunc("week", "l_shipdate")).cast("date")
    spans = lines.select(F.col("l_suppkey").alias("asset_id"), quarter.alias("valid_from")).distinct().join(panel.assets(spark, sf_dir).select("asset_id", "market"), "asset_id")
    each = spans.select("asset_id", "market").distinct()
    size = each.groupBy("market").agg(F.count(F.lit(1)).alias("n"))
    placed = each.withColumn("i", w.first_rank("asset_id", ("market",))).join(size, "market")
    steps = placed.select("market", "asset_id", F.explode(F.array(*[F.lit(d) for d in range(1, 5)])).alias("d"), "i", "n").where("d < n")
    pairs = steps.withColumn("i", (F.col("i") - 1 + F.col("d")) % F.col("n") + 1).join(placed.select("market", "i", F.col("asset_id").alias("peer_asset_id")), ["market", "i"])
    end = F.when((F.col("asset_id") + F.month("valid_from")) % 9 != 0, F.add_months("valid_from", 6))
    moved = panel.bars(spark, sf_dir).select("asset_id", "market", "date", w.change("adj_close", 3).alias("v"))
    bound = {"last": lines.agg(F.max(F.col("l_shipdate").cast("date"))).first()[0], "parts": panel.parts(spark, sf_dir)}
    return moved, pairs.select("asset_id", "peer_asset_id").join(spans.drop("market"), "asset_id").withColumn("valid_to", end), bound


@register("peer_values", f"WITH {_EDGES} SELECT date, market, asset_id, peer AS peer_asset_id, round(v, 6) + 0.0 AS v, round(pv, 6) + 0.0 AS peer_value FROM pv")
def peer_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved, pairs, bound = edges(spark, sf_dir)
    return rounded(peers.peer_values(moved, pairs, "v", **bound), ["date", "market", "asset_id", "peer_asset_id"], ["v", "peer_value"])


_DISLOCATED = f"""WITH {_EDGES}, ps AS (SELECT date, asset_id, market, count(*) AS peer_count, median(pv) AS med FROM pv GROUP BY ALL),
rw AS (SELECT mv.*, coalesce(peer_count, 0) AS peer_count, CASE WHEN peer_count >= 3 THEN v - med END AS raw FROM mv LEFT JOIN ps USING (date, asset_id, market)),
sc AS (SELECT *, {s.roll('median', 'raw', 30, 12, shift=1)} AS center, 1.4826 * {s.roll('mad', 'raw', 30, 12, shift=1)} AS scale FROM rw)
SELECT asset_id, market, date, peer_count, round(raw, 6) + 0.0 AS raw_dislocation, round(CASE WHEN scale > 1e-12 THEN -(raw - center) / scale END, 5) + 0.0 AS factor_value FROM sc"""


@register("factors_peer_dislocation", _DISLOCATED)
def factors_peer_dislocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved, pairs, bound = edges(spark, sf_dir)
    out = peers.peer_dislocation(moved, pairs, "v", least_peers=3, n=30, least=12, **bound)
    return out.select("asset_id", "market", "date", "peer_count", (F.round("raw_dislocation", 6) + F.lit(0.0)).alias("raw_dislocation"), (F.round("factor_value", 5) + F.lit(0.0)).alias("factor_value"))


N, RETURNS, ASSETS, PAIRS, CORRELATION, MOST, LEAST = 40, 25, 4, 20, 0.1, 5, 2
_COMOVING = f"""WITH {s.BARS}, dy AS (SELECT market, date, row_number() OVER (PARTITION BY market ORDER BY date) AS session FROM (SELECT DISTINCT market, date FROM bars)),
dn AS (SELECT *, lag(date) OVER (PARTITION BY market ORDER BY session) AS before, max(date) OVER (PARTITION BY market) AS last FROM dy),
fm AS (SELECT *, row_number() OVER (PARTITION BY market, year(date), month(date) ORDER BY session) AS k FROM dn WHERE month(date) IN (1, 4, 7, 10)),
sd AS (SELECT market, date AS valid_from, session, before AS source_end, coalesce(lead(before) OVER (PARTITION BY market ORDER BY session), last) AS valid_to FROM fm WHERE k = 1),
pr AS (SELECT b.market, asset_id, b.date, session, adj_close, lag(session) OVER w AS ps, lag(adj_close) OVER w AS pp FROM bars b JOIN dy USING (market, date) WINDOW w AS (PARTITION BY b.market, asset_id ORDER BY b.date)),
rt AS (SELECT *, CASE WHEN ps = session - 1 THEN adj_close / nullif(pp, 0) - 1 END AS r FROM pr),
iw AS (SELECT sd.valid_from, rt.*, count(r) OVER (PARTITION BY rt.market, sd.valid_from, asset_id) AS n, max(CAST(date = source_end AS INTEGER)) OVER (PARTITION BY rt.market, sd.valid_from, asset_id) AS traded FROM rt JOIN sd ON sd.market = rt.market AND sd.session > 1 AND rt.session BETWEEN sd.session - {N} AND sd.session - 1),
rd AS (SELECT *, CASE WHEN count(r) OVER d >= {ASSETS} THEN median(r) OVER d END AS m FROM iw WHERE traded = 1 AND n >= {RETURNS} WINDOW d AS (PARTITION BY market, valid_from, session)),
ft AS (SELECT market, valid_from, asset_id, covar_pop(r, m) / var_pop(m) AS slope, avg(r) AS ar, avg(m) AS am FROM rd WHERE r IS NOT NULL AND m IS NOT NULL GROUP BY ALL HAVING count(*) >= {PAIRS} AND var_pop(m) > 0),
rs AS (SELECT market, valid_from, asset_id, session, r - (ar - slope * am) - slope * m AS e FROM rd JOIN ft USING (market, valid_from, asset_id) WHERE r IS NOT NULL AND m IS NOT NULL),
cr AS (SELECT a.market, a.valid_from, a.asset_id, b.asset_id AS peer_asset_id, corr(a.e, b.e) AS similarity, count(*) AS n FROM rs a JOIN rs b ON a.market = b.market AND a.valid_from = b.valid_from AND a.session = b.session AND a.asset_id <> b.asset_id GROUP BY ALL HAVING count(*) >= {PAIRS}),
rk AS (SELECT *, row_number() OVER (PARTITION BY market, valid_from, asset_id ORDER BY similarity DESC, peer_asset_id) AS peer_rank FROM cr WHERE similarity >= {CORRELATION}),
ct AS (SELECT *, count(*) OVER (PARTITION BY market, valid_from, asset_id) AS peer_count FROM rk WHERE peer_rank <= {MOST})
SELECT market, valid_from, valid_to, source_end, asset_id, peer_asset_id, n AS pair_observations, CAST(peer_rank AS INTEGER) AS peer_rank, peer_count, round(similarity, 6) AS similarity FROM ct JOIN sd USING (market, valid_from) WHERE peer_count >= {LEAST}"""


@register("comovement_peers", _COMOVING)
def comovement_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    # read for the calendar, the medians and the residuals: 12 bytes a bar, where the order lines take some 25
    parts = panel.parts(spark, sf_dir)
    held = store.cut(peers.histories(panel.bars(spark, sf_dir)))
    held = held.coalesce(-(-parts // 8)) if parts else held
    schedule = peers.rebalance_schedule(peers.days_of(held), (1, 4, 7, 10), N)
    left = peers.residuals_of(held, schedule, RETURNS, ASSETS, PAIRS)
    most = panel.assets(spark, sf_dir).withColumn("valid_from", F.lit(0))  # no window has more assets than its market
    blocks = peers.blocks_for(most, peers.TASK_ASSETS)
    out = peers.comovement_peers(left, schedule, MOST, LEAST, PAIRS, CORRELATION, blocks, parts)
    return rounded(out, ["market", "valid_from", "valid_to", "source_end", "asset_id", "peer_asset_id", "pair_observations", "peer_rank", "peer_count"], ["similarity"])
