"""Plans and helpers that keep a task's memory and the shuffles in step with the input."""

from pyspark.sql import functions as F

from quillon import panel
from quillon.functions import windows as w
from quillon.operators import technical

KEYS = ["asset_id", "market", "date"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranks_of_several_values_equal_single_windows(spark):
    rows = [(i % 7, "m" if i % 3 else None, i % 2, None if i % 5 == 0 else float(i % 4), float("nan") if i % 6 == 0 else -float(i)) for i in range(60)]
    df = spark.createDataFrame([*rows, rows[1]], "asset_id long, market string, date int, a double, b double")
    values = {"ra": F.col("a"), "rb": F.col("b")}
    several = w.pct_ranks(w.deal(df), values).select(*df.columns, *values)
    single = df.withColumns({n: w.pct_rank(v) for n, v in values.items()})
    assert sorted(map(repr, several.collect())) == sorted(map(repr, single.collect()))


def test_ranks_of_technical_factors_share_a_sort(spark, sf_dir):
    found = plan(technical.technical(panel.bars(spark, sf_dir), 5, parts=8))
    assert found.count(" Sort [") <= 6 and "hashpartitioning(date" in found and ", 8)" in found


def test_panel_is_dealt_by_asset_once(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # the smallest panel would be broadcast to its assets
    try:
        found = plan(panel.bars(spark, sf_dir).withColumn("before", w.lag("adj_close")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the lines once, and the table of assets for the join
    assert found.count("Exchange hashpartitioning(l_suppkey") == 1 and found.count("Exchange hashpartitioning(asset_id") == 1


def test_large_panels_have_more_partitions(spark, sf_dir, monkeypatch):
    assert panel.parts(spark, sf_dir) is None
    monkeypatch.setattr(panel, "PART_LINES", 100)
    assert panel.parts(spark, sf_dir) == 60
    bars = panel.bars(spark, sf_dir)
    assert "hashpartitioning(l_suppkey" in plan(bars) and ", 60)" in plan(bars)


def test_side_tables_of_the_lines_need_no_second_scan(spark, sf_dir):
    from quillon.plans import input_queries

    assert plan(input_queries.valued(spark, sf_dir)).count("l_extendedprice:double") == 1


def test_ranks_of_turnover_within_buckets_share_sorts(spark, sf_dir):
    from quillon.operators import inputs
    from quillon.plans import input_queries

    assert plan(inputs.turnover_combo(input_queries.valued(spark, sf_dir), 8)).count(" Sort [") <= 8


def test_ranks_of_the_ensemble_share_a_sort(spark, sf_dir):
    from quillon.operators import composites
    from quillon.plans import input_queries

    assert plan(composites.anomaly_ensemble(input_queries.valued(spark, sf_dir), 8)).count("Sort [date") <= 2


def test_bridge_deals_its_factors_once(spark):
    from quillon.operators import composites

    rows = [(1, "m", "2020-01-06", 0.1), (2, "m", "2020-01-06", 0.2), (3, "m", "2020-01-06", None)]
    side = lambda name, mine: spark.createDataFrame(mine, f"asset_id long, market string, date string, {name} double")
    out = composites.risk_filter_bridge(side("x", rows), side("y", rows[1:] + [(4, "m", "2020-01-06", 0.3)]), "x", "y", parts=8)
    assert plan(out).count("Exchange hashpartitioning") == 1
    assert {r.asset_id: r[3] for r in out.collect()} == {1: None, 2: 0.75, 3: None, 4: None}


def test_flows_shuffle_lines_by_asset(spark, sf_dir):
    from quillon.plans import input_queries

    found = plan(input_queries.flows(spark, sf_dir))
    assert "REPARTITION_BY_COL" in found and found.count("Exchange hashpartitioning(l_suppkey") == 1


def test_blocks_of_peers_are_few(spark):
    from quillon.operators import peers

    sizes = spark.range(4000).selectExpr("'m' as market", "date'2020-01-01' as valid_from", "id as asset_id")
    assert peers.blocks_for(sizes) == 2


def test_peers_meet_once_and_arrays_are_sent_once_a_block(spark):
    from quillon.operators import peers

    sizes = spark.range(72_000).selectExpr("'m' as market", "date'2020-01-01' as valid_from", "id as asset_id")
    assert peers.blocks_for(sizes, peers.TASK_ASSETS) == 1
    rows = [tuple(r) for r in peers.to_blocks(sizes.where("asset_id < 60"), 4).select("asset_id", "own", "low", "high").collect()]
    assert len(rows) == 4 * 60
    pairs = [(a, b) for a, own, low, high in rows for b, its, *at in rows if a < b and at == [low, high] and (own != its or low == high)]
    assert sorted(pairs) == [(a, b) for a in range(60) for b in range(a + 1, 60)]


def test_windows_of_peers_are_cut_where_the_assets_lie(spark, sf_dir):
    import __spark_entry__ as entry

    found = plan(entry.queries()["comovement_peers"](spark, sf_dir))
    assert "l_suppkey" not in found and found.count("Exchange hashpartitioning(market#") <= 12
    by_asset = [line for line in found.splitlines() if "Exchange hashpartitioning(market#" in line and "asset_id#" in line]
    assert len(by_asset) == 1  # the edges found; no window of an asset is shuffled to be made


def test_correlated_cross_sections_are_dealt_in_step(spark):
    from quillon.operators import evaluate

    left = spark.createDataFrame([("2020-01-06", i, "m", "f", float(i)) for i in range(5)], "date string, asset_id long, market string, factor_name string, factor_value double")
    out = evaluate.factor_correlation(left, left, parts=8)
    assert "REPARTITION_BY_NUM" in plan(out) and round(out.first().mean_correlation, 9) == 1.0


def test_dates_of_a_grid_are_counted_over_picked_rows(spark):
    from quillon.operators import portfolio

    f = spark.range(40).selectExpr("cast(id % 4 as string) as date", "id as asset_id", "'m' as market", "'f' as factor_name", "cast(id as double) as factor_value")
    out = portfolio.select_grid(f, [{"case_no": 0, "top_n": 2, "every": 2}])
    found = plan(out)
    assert "Filter" in found[found.index("dense_rank") : found.index("row_number")]
    assert sorted((r.date, r.asset_id) for r in out.collect()) == [("0", 32), ("0", 36), ("2", 34), ("2", 38)]


def test_peers_are_dealt_in_step_and_facts_read_once_for_both_ends(spark):
    from datetime import date

    from quillon.operators import peers

    facts = spark.createDataFrame([(date(2020, 1, d), a, "m", float(a * d)) for d in range(1, 9) for a in range(4)], "date date, asset_id int, market string, v double")
    edges = spark.createDataFrame([(a, b, date(2020, 1, 1), end) for a in range(4) for b in range(4) if a != b for end in (None, date(2020, 1, 5))], "asset_id int, peer_asset_id int, valid_from date, valid_to date")
    out = peers.peer_dislocation(facts, edges, "v", 2, 4, 2, last=date(2020, 2, 1), parts=8)
    found = plan(out)
    # spans by edge; facts and spans by month; both ends by peer; facts with peers by asset
    assert found.count("REPARTITION_BY_NUM") == 6 and found.count("Exchange") == 6
    assert {r.peer_count for r in out.collect()} == {3}


def test_residual_composites_are_computed_once(spark, sf_dir):
    from quillon.operators import residuals
    from quillon.plans import input_queries

    found = plan(residuals.residual_composites(input_queries.valued(spark, sf_dir), 8))
    assert found.count("l_extendedprice:double") == 1 and found.count("Exchange hashpartitioning(date") == 1


def test_smart_money_is_dealt_by_asset_and_by_date_once(spark, sf_dir):
    from quillon.operators import composites
    from quillon.plans import input_queries

    found = plan(composites.SMART_MONEY.compute(input_queries.valued(spark, sf_dir), parts=8))
    assert found.count("Exchange hashpartitioning(date") == 1 and found.count("Exchange hashpartitioning(asset_id") <= 1
    # four ranks of the gates, one sort for the buckets of all scores, one for the ranks within them, those of the joins
    assert found.count(" Sort [date") <= 9


def test_residual_risk_takes_no_frames_row_by_row(spark, sf_dir):
    from quillon.operators import residuals

    found = plan(residuals.residual_risk(panel.bars(spark, sf_dir), parts=8))
    assert "specifiedwindowframe(RowFrame, -119" not in found and found.count("REPARTITION_BY_NUM") == 2


def scans(df, column="l_extendedprice:double"):
    return plan(df).count(column)


def test_factors_and_labels_are_one_narrow_row(spark, sf_dir):
    from quillon.operators import evaluate
    from quillon.plans import core_queries

    rows, keys = core_queries.study_rows(spark, sf_dir)
    joined, joined_keys = evaluate.merged(*core_queries.study(spark, sf_dir))
    assert keys == joined_keys and scans(rows) == 1 and plan(rows).count("Exchange hashpartitioning(date") == 1
    columns = [*keys, "asset_id", "factor_value", "forward_return"]
    assert sorted(rows.select(columns).collect()) == sorted(joined.select(columns).collect())


def test_curves_are_not_computed_again_for_folds_states_and_amounts(spark, sf_dir):
    import __spark_entry__ as entry

    queries = entry.queries()
    assert scans(queries["purged_folds"](spark, sf_dir)) == 1
    assert scans(queries["state_conditioned_ic"](spark, sf_dir)) == 1
    assert scans(queries["top_quantile_capacity"](spark, sf_dir)) == 1
    assert scans(queries["combination_paths"](spark, sf_dir)) == 2  # curves, and the dates of their groups


def test_trades_carry_what_rules_look_at(spark, sf_dir):
    import __spark_entry__ as entry

    queries = entry.queries()
    # signals and prices of trades, for the template and for the flagged trades
    assert scans(queries["trade_exclusion_unmatched"](spark, sf_dir)) == 4
