"""Operators on small frames with results worked out by hand or by pandas."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.functions import windows as w
from quillon.operators import asof, evaluate, families, inputs, labels, neutralize, portfolio, quality, residuals, technical, validate
from quillon.sources import store
from quillon.streaming import upsert

D0 = dt.date(2024, 1, 1)


def day(i):
    return D0 + dt.timedelta(days=i)


def bars(spark, prices, **more):
    """prices: asset -> list of prices, None for a missing bar."""
    rows = []
    for a, ps in prices.items():
        for i, p in enumerate(ps):
            if p is not None:
                rows.append((a, "M", "I" if a % 2 else "J", day(i), float(p), p * 1.02, p * 0.98, 10.0 + i, p * (10.0 + i)))
    df = spark.createDataFrame(rows, "asset_id long, market string, industry string, date date, adj_close double, high double, low double, volume double, amount double")
    return df.withColumns({"open": F.col("adj_close"), "close": F.col("adj_close")} | more)


@pytest.fixture(scope="module")
def walk(spark):
    rng = np.random.default_rng(0)
    return bars(spark, {a: (100 * np.cumprod(1 + 0.03 * rng.standard_normal(90))).tolist() for a in range(1, 9)})


FAMILIES = {
    "technical": lambda b: technical.technical(b, 20),
    "public_technical": families.public_technical,
    "liquidity": families.TECHNICAL_LIQUIDITY.compute,
    "tail_guard": families.TECHNICAL_TAIL_GUARD.compute,
    "trend_volume": families.TREND_VOLUME.compute,
    "trend_strength": families.TREND_STRENGTH.compute,
    "rsrs": families.rsrs,
    "formula": families.FORMULA_PRICE_VOLUME.compute,
    "discreteness": families.INFORMATION_DISCRETENESS.compute,
    "shock": families.LIQUIDITY_SHOCK.compute,
    "breadth": lambda b: families.industry_breadth(b, 2),
    "leaders": lambda b: families.industry_leaders(b, least=2),
    "theme": lambda b: inputs.theme_breadth(b, n=20),
    "residual_risk": lambda b: residuals.residual_risk(b, 4, 40, 20, 8, 20, 10),
    "skip": inputs.skip_momentum,
}


@pytest.mark.parametrize("name", FAMILIES)
def test_later_rows_change_nothing_before_them(walk, name):
    f = FAMILIES[name]
    cut = day(70)
    whole = f(walk).where(F.col("date") <= F.lit(cut)).orderBy("asset_id", "date").toPandas()
    short = f(walk.where(F.col("date") <= F.lit(cut))).orderBy("asset_id", "date").toPandas()
    pd.testing.assert_frame_equal(whole, short, check_exact=False, rtol=1e-9)


def test_factors_against_pandas(walk):
    got = technical.technical(walk, 20, ("momentum", "volatility", "average_amount")).join(families.public_technical(walk), ["asset_id", "market", "date"]).orderBy("asset_id", "date").toPandas()
    raw = walk.orderBy("asset_id", "date").toPandas()
    g = raw.groupby("asset_id")
    ret = g["adj_close"].pct_change(fill_method=None)
    want = pd.DataFrame({"momentum": raw["adj_close"] / g["adj_close"].shift(20) - 1, "volatility": ret.groupby(raw["asset_id"]).transform(lambda s: s.rolling(20).std(ddof=0)), "average_amount": np.log1p(g["amount"].transform(lambda s: s.rolling(20).mean()))})
    move = g["adj_close"].diff()
    gain, loss = (x.groupby(raw["asset_id"]).transform(lambda s: s.rolling(14).mean()) for x in (move.clip(lower=0), -move.clip(upper=0)))
    want["rsi_reversal_14"] = 100 / (1 + gain / loss)
    pd.testing.assert_frame_equal(got[list(want)], want, check_exact=False, rtol=1e-8)


def test_unknown_factor_names_are_refused(walk):
    with pytest.raises(ValueError, match="unknown"):
        technical.technical(walk, 5, ("nonsense",))
    with pytest.raises(ValueError, match="unknown"):
        families.TREND_VOLUME.compute(walk, ("nonsense",))


def test_only_requested_windows_are_planned(walk):
    plan = technical.technical(walk, 20, ("momentum",))._jdf.queryExecution().optimizedPlan().toString()
    assert "stddev" not in plan and plan.count("Window") <= 2


@pytest.mark.parametrize("values", [[1, 2, 2, 3, None], [5, 5, 5], [None, None], [1], [3, 1, 2, 2, 2, 9, -1]])
def test_ranks_and_buckets_against_pandas(spark, values):
    df = spark.createDataFrame([(i, "M", D0, None if v is None else float(v)) for i, v in enumerate(values)], "asset_id long, market string, date date, v double")
    got = df.select("asset_id", w.pct_rank("v").alias("p"), w.zscore("v").alias("z"), w.ceil_bucket("v", 5, w.CROSS).alias("c")).orderBy("asset_id").toPandas()
    s = pd.Series(values, dtype=float)
    np.testing.assert_allclose(got["p"].astype(float), s.rank(pct=True))
    sd = s.std(ddof=0)
    np.testing.assert_allclose(got["z"].astype(float), (s - s.mean()) / (sd if sd > 1e-12 else np.nan))
    want = np.clip(np.ceil(s.rank(method="first", pct=True) * 5), 1, 5)
    np.testing.assert_allclose(got["c"].astype(float), want)


@pytest.mark.parametrize("n", [5, 6, 9, 23, 100])
def test_edge_buckets_match_qcut(spark, n):
    df = spark.createDataFrame([(i, "M", D0, float(i * 7 % n)) for i in range(n)], "asset_id long, market string, date date, v double")
    got = df.select("asset_id", w.edge_bucket("v", 5, w.CROSS).alias("b")).orderBy("asset_id").toPandas()["b"]
    want = pd.qcut(pd.Series([i * 7 % n for i in range(n)]).rank(method="first"), 5, labels=False)
    assert got.tolist() == want.tolist()


def test_labels_count_the_assets_own_bars(spark):
    b = bars(spark, {1: [10, 11, 12, 13], 2: [10, None, 20, 40]})
    rows = {(r.asset_id, r.date): (r.forward_return, r.entry_date, r.exit_date) for r in labels.forward_returns(b, (1,)).collect()}
    assert rows[1, day(0)] == (pytest.approx(12 / 11 - 1), day(1), day(2)) and (1, day(2)) not in rows
    assert rows[2, day(0)] == (pytest.approx(1.0), day(2), day(3))
    kept = {(r.asset_id, r.date) for r in labels.aligned_labels(labels.forward_returns(b, (1,)), b).collect()}
    assert (1, day(0)) in kept and (2, day(0)) not in kept


def test_information_coefficient_edges(spark):
    f = spark.createDataFrame([(day(0), a, "M", "f", float(v)) for a, v in enumerate([1, 2, 3, 4])] + [(day(1), a, "M", "f", 1.0) for a in range(3)] + [(day(2), 0, "M", "f", 1.0)], "date date, asset_id long, market string, factor_name string, factor_value double")
    l = spark.createDataFrame([(day(d), a, "M", 1, 1, float(a) if d else float(a * a)) for d in range(3) for a in range(4)], "date date, asset_id long, market string, horizon int, execution_lag int, forward_return double")
    got = {r.date: r for r in evaluate.information_coefficient(f, l).collect()}
    assert got[day(0)].rank_ic == pytest.approx(1) and got[day(0)]['count'] == 4 and got[day(0)].rank_ic_p_value == pytest.approx(0, abs=1e-6)
    assert got[day(1)].ic is None and got[day(2)].rank_ic is None


def test_newey_west_by_hand(spark):
    x = np.random.default_rng(1).standard_normal(60) + 0.2
    df = spark.createDataFrame([("k", day(i), float(v)) for i, v in enumerate(x)], "k string, date date, v double")
    r = evaluate.newey_west(df, ["k"], "v").first()
    c, n, lags = x - x.mean(), 60, int(4 * (60 / 100) ** (2 / 9))
    s = c @ c + sum(2 * (1 - k / (lags + 1)) * (c[k:] @ c[:-k]) for k in range(1, lags + 1))
    assert r.max_lag == lags and r.t_stat == pytest.approx(x.mean() / math.sqrt(s / (n - 1) / n))
    assert r.p_value == pytest.approx(math.erfc(abs(r.t_stat) / math.sqrt(2)))


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([("a", i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.5])], "k string, i int, p double")
    got = {r.i: r.bh_p_value for r in evaluate.benjamini_hochberg(df, "p", ["k"], ["i"]).collect()}
    assert [round(got[i], 6) for i in range(4)] == [0.04, round(0.04 * 4 / 3, 6), round(0.04 * 4 / 3, 6), 0.5]


def test_residuals_are_orthogonal_and_singular_cross_sections_are_skipped(spark):
    rng = np.random.default_rng(2)
    rows = [(a, "M", day(d), float(rng.normal()), float(rng.normal()) if d else 1.0, float(rng.normal())) for d in range(2) for a in range(30)]
    df = spark.createDataFrame(rows, "asset_id long, market string, date date, y double, x double, z double")
    out = neutralize.ols_residual(df, "y", ["x", "z"]).toPandas()
    good = out[out.date == day(1)]
    assert abs(good.residual @ good.x) < 1e-9 and abs(good.residual.sum()) < 1e-9
    assert out[out.date == day(0)].residual.isna().all()
    least = neutralize.ols_residual(df, "y", ["x", "z"], on_singular="min_norm").toPandas()
    assert least[least.date == day(0)].residual.notna().all()


def test_asof_takes_nothing_from_the_future(spark):
    left = spark.createDataFrame([(1, day(i)) for i in (0, 2, 5)] + [(2, day(3))], "k long, date date")
    right = spark.createDataFrame([(1, day(1), "a"), (1, day(5), "b"), (3, day(0), "c")], "k long, known date, v string")
    got = {(r.k, r.date): r.v for r in asof.asof_by_key(left, right, ["k"], "date", "known", ["v"]).collect()}
    assert got == {(1, day(0)): None, (1, day(2)): "a", (1, day(5)): "b", (2, day(3)): None}


def test_session_after_event(spark):
    b = bars(spark, {1: [1, 1, None, 1, 1]})
    e = spark.createDataFrame([("M", day(1)), ("M", day(2)), ("M", day(4))], "market string, at date")
    strict = {r["at"]: r.signal_date for r in asof.session_after(e, b, "at").collect()}
    assert strict == {day(1): day(3), day(2): day(3)}
    loose = {r["at"]: r.signal_date for r in asof.session_after(e, b, "at", strict=False).collect()}
    assert loose == {day(1): day(1), day(2): day(3), day(4): day(4)}


def test_trades_gates_and_delayed_exits(spark):
    b = bars(spark, {1: [10, 11, 12, 13, 14, 15]}, entry_tradeable=F.col("date") != F.lit(day(2)), exit_tradeable=~F.col("date").isin(day(3), day(4)))
    signals = spark.createDataFrame([(day(i), 1, "M", "f", 1.0, 1.0) for i in range(5)], "date date, asset_id long, market string, factor_name string, factor_value double, target_weight double")
    t = {r.signal_date: r for r in portfolio.build_trades(signals, b, lag=1, hold=2, cost_bps=10.0, max_days=4).collect()}
    assert t[day(0)].exit_date == day(5) and t[day(0)].delayed and t[day(0)].net_return == pytest.approx(15 / 11 - 1 - 0.002)
    assert t[day(1)].reject == "entry_not_tradeable" and day(3) not in t
    assert portfolio.build_trades(signals, b, lag=1, hold=2, max_days=3).where("signal_date = date'2024-01-01'").first().reject == "exit_not_tradeable"
    small = portfolio.build_trades(signals, b.withColumn("amount", F.lit(0.0)), lag=1, hold=2, impact=5.0).where("signal_date = date'2024-01-01'").first()
    assert small.reject == "amount_missing"


def test_selection_ties_and_metrics(spark):
    f = spark.createDataFrame([(D0, a, "M", "f", v) for a, v in [(3, 1.0), (1, 1.0), (2, 2.0), (4, None)]], "date date, asset_id long, market string, factor_name string, factor_value double")
    assert sorted(r.asset_id for r in portfolio.select_top(f, 2).collect()) == [1, 2]
    c = spark.createDataFrame([("k", day(i), r) for i, r in enumerate([0.1, -0.5, 0.2])], "k string, exit_date date, weighted_return double").withColumn("reject", F.lit(None).cast("string"))
    m = portfolio.return_metrics(portfolio.equity(c, ["k"]), ["k"]).first()
    assert m.total_return == pytest.approx(1.1 * 0.5 * 1.2 - 1) and m.max_drawdown == pytest.approx(-0.5) and m.win_rate == pytest.approx(2 / 3)


def test_weight_turnover(spark):
    rows = [(day(0), 1, 0.5), (day(0), 2, 0.5), (day(1), 1, 1.0)]
    wt = spark.createDataFrame([("p", *r) for r in rows], "p string, signal_date date, asset_id long, target_weight double")
    assert portfolio.weight_turnover(wt, ["p"]).first().turnover == pytest.approx((0.5 * 2 + 0.5 * 1.0) / 2)


def test_quality(spark):
    b = bars(spark, {1: [1, 1, 1, 2, 2], 2: [5, None, 5, 6, 7]})
    assert [(r.asset_id, r.date) for r in quality.gaps(b).collect()] == [(2, day(1))]
    assert {(r.asset_id, r.start, r.length) for r in quality.runs(b, "adj_close", 3).collect()} == {(1, day(0), 3)}
    bad = b.withColumn("high", F.when(F.col("date") == F.lit(D0), 0.1).otherwise(F.col("high")))
    assert {r.asset_id: r.bad_order for r in quality.violations(bad).collect()} == {1: 1, 2: 1}


def test_folds_and_choice(spark):
    rows = [("m", c, day(i), 0.01 * (1 if (i < 6) == (c == 0) else -1) + 0.001 * (i % 3)) for c in range(2) for i in range(12)]
    curves = spark.createDataFrame(rows, "k string, case_no int, date date, period_return double")
    folds = validate.rolling_folds(curves, 4, 4, ["k"])
    assert [(r.fold, r.train_start, r.test_end) for r in folds.orderBy("fold").collect()] == [(0, day(0), day(7)), (1, day(4), day(11))]
    assert [r.case_no for r in validate.walk_forward_choice(curves, folds, ["k"], "case_no").orderBy("fold").collect()][0] == 0


def test_store_round_trip_prunes_and_replaces_partitions(spark, tmp_path):
    path = str(tmp_path / "bars")
    b = bars(spark, {1: [1] * 10}).withColumn("date", F.when(F.col("date") > F.lit(day(4)), F.add_months("date", 12)).otherwise(F.col("date")))
    store.write(b, path)
    part = store.scan(spark, path, "M", dt.date(2025, 1, 1), dt.date(2025, 12, 31))
    assert part.count() == 5 and "year" in part._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("]")[0]
    store.write(b.where("year(date) = 2025").limit(2), path)
    assert store.scan(spark, path).count() == 7
    with pytest.raises(ValueError, match="repeat"):
        store.stitch([(b, None, None), (b, day(0), day(1))], ["asset_id", "date"])
    assert store.catalogue(spark, path).agg(F.sum("rows")).first()[0] == 7


def test_upsert_and_adjustment(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, store.keep_last(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    b = bars(spark, {1: [2, 4]})
    whole = spark.createDataFrame([(1, day(0), 0.5), (1, day(1), 1.0)], "asset_id long, date date, factor double")
    assert [r.adj_close for r in store.attach_adjusted(b, whole, ["asset_id", "date"]).orderBy("date").collect()] == [1.0, 4.0]
    assert [r.adj_close for r in store.attach_adjusted(b, whole.limit(1), ["asset_id", "date"]).orderBy("date").collect()] == [2.0, 4.0]
    same = store.fingerprint(b).first()
    assert same == store.fingerprint(b.orderBy(F.desc("date"))).first() and same != store.fingerprint(b.limit(1)).first()


def test_stream_of_bars_is_landed_and_replayed_without_change(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    first = bars(spark, {1: [1, 2, 3]}).select("asset_id", "market", "date", "adj_close")
    first.coalesce(1).write.parquet(source)
    run = lambda n: upsert.land(spark.readStream.schema(first.schema).parquet(source), path, str(tmp_path / n), ["asset_id", "date"]).awaitTermination()
    run("a")
    assert spark.read.parquet(path).count() == 3
    first.withColumn("adj_close", F.lit(9.0)).limit(1).coalesce(1).write.mode("append").parquet(source)
    run("a")
    assert sorted(r.adj_close for r in spark.read.parquet(path).collect()) == [2.0, 3.0, 9.0]


def test_residuals_of_equal_and_dependent_columns(spark):
    rng = np.random.default_rng(4)
    rows = [(a, "M", day(d), y := float(rng.normal()), x := float(rng.normal()), 0.1, 3 * x + 1, float("nan") if (a, d) == (3, 1) else y) for d in range(2) for a in range(31)]
    df = spark.createDataFrame(rows, "asset_id long, market string, date date, y double, x double, c double, z double, n double")
    alone = {(r.date, r.asset_id): r.residual for r in neutralize.ols_residual(df, "y", ["x"]).collect()}
    for xs in (["c", "x"], ["x", "z"], ["z", "c", "x"]):
        least = {(r.date, r.asset_id): r.residual for r in neutralize.ols_residual(df, "y", xs, on_singular="min_norm").collect()}
        assert all(least[k] == pytest.approx(v) for k, v in alone.items())
        assert all(r.residual is None for r in neutralize.ols_residual(df, "y", xs).collect())
    for y, xs in (("n", ["x"]), ("y", ["n", "x"])):
        got = neutralize.ols_residual(df, y, xs, on_singular="min_norm").collect()
        assert all((r.residual is None) == (r.date == day(1)) for r in got)
