"""Exclusions, funds, members, baskets, timing; state overlays, spreads, breadth, folds; exact quantiles."""

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillon.functions import windows as w
from quillon.operators import asof, evaluate, inputs, neutralize, overlays, robustness, universe
from quillon.plans import landing_queries, registry  # noqa: F401

from .test_operators import day


def test_exclusions(spark):
    bars = spark.createDataFrame([(a, day(i), c, p) for a in range(1, 6) for i, (c, p) in enumerate([(10.0, 10.0), (10.0, 10.5), (0.0, 99.0), (10.0, 30.0 if a == 2 else 10.4)])], "asset_id int, date date, close double, adj_close double")
    life = spark.createDataFrame([(1, day(1), day(2)), (2, day(0), None), (3, day(0), None), (5, None, day(1))], "asset_id int, list_date date, delist_date date")
    held = spark.createDataFrame([(3,), (3,), (9,)], "asset_id int")
    got = {(r.asset_id, (r.date - day(0)).days): r.excluded for r in universe.exclusion_reasons(bars, life, held, 2.0, True).collect()}
    assert len(got) == 20
    assert [got[1, i] for i in range(4)] == ["unlisted", None, None, "delisted"]
    assert {got[2, i] for i in range(4)} == {"ratio_jump"} and {got[3, i] for i in range(4)} == {"quarantined"}
    assert {got[4, i] for i in range(4)} == {got[5, i] for i in range(4)} == {"unknown"}
    assert universe.authority_bars(bars, life, held).count() == 10
    for wrong in ([(1, day(0), None), (1, day(1), None)], [(1, day(3), day(1))]):
        with pytest.raises(PySparkException, match="asset 1"):
            universe.authority_bars(bars, spark.createDataFrame(wrong, "asset_id int, list_date date, delist_date date"), held).collect()


def test_active_funds(spark):
    rows = [("510300.sh", "a ETF", "e", "L", day(0), None), ("1.SZ", "b etf", "E", "D", day(0), day(10)), ("2.OF", "c ETF", "E", "L", day(0), None), ("3.SH", "d fund", "E", "L", day(0), None), ("4.SH", "e ETF", "O", "L", day(0), None), ("5.SH", None, "E", "L", None, None), ("6.SZ", "f ETF", "E", "L", None, None)]
    funds = spark.createDataFrame(rows, "symbol string, name string, market string, status string, list_date date, delist_date date")
    names = lambda df: sorted(r.symbol for r in df.collect())
    assert names(universe.active_funds(funds, str(day(9)))) == ["1.SZ", "510300.SH"] and names(universe.active_funds(funds, str(day(10)))) == ["510300.SH"]
    assert names(universe.active_funds(funds)) == ["510300.SH", "6.SZ"]
    assert names(universe.active_funds(funds.withColumn("is_etf", F.col("symbol") == "3.SH"))) == ["3.SH"]


def test_rotation_members(spark):
    signals = spark.createDataFrame([(day(d), a, d * 10.0 + a) for d in range(3) for a in range(4)], "date date, asset_id int, factor_value double")
    rows = [(day(0), a, True, 5) for a in (0, 1)] * 2 + [(day(1), a, a < 3, 1 + a) for a in range(4)] + [(day(2), 0, None, 9)]
    membership = spark.createDataFrame(rows, "date date, asset_id int, is_rotation_member boolean, history_rows int")
    got = lambda *k: sorted(((r.date - day(0)).days, r.asset_id) for r in universe.rotation_members(signals, membership, *k).collect())
    assert got() == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2)] and got(2, None) == [(0, 0), (0, 1), (1, 1), (1, 2)] and got(None, 3) == [(1, 0), (1, 1), (1, 2)] and got(3, 2) == [(0, 0), (0, 1)]


def test_basket_weights(spark):
    rows = [("f", "a", day(0), 30.0, None), ("F", "b", day(0), -1.0, 10.0), ("f", "c", day(0), None, None), ("f", "a", day(9), 5.0, 1.0), ("g", "a", day(0), 0.0, 2.0), ("f", "a", None, 1.0, 1.0)]
    got = sorted((r.fund_symbol, r.stock_symbol, r.known_date, r.end_date, r.weight) for r in universe.basket_weights(spark.createDataFrame(rows, "fund_symbol string, stock_symbol string, known_date date, mkv double, stk_mkv_ratio double")).collect())
    assert got == [("F", "A", day(0), day(8), 0.75), ("F", "A", day(9), None, 1.0), ("F", "B", day(0), day(8), 0.25), ("G", "A", day(0), None, 1.0)]


def test_timing_audit(spark):
    bars = spark.createDataFrame([(1, "M", day(i)) for i in (0, 5, 30)], "asset_id int, market string, date date")
    rows = [(1, "M", day(0), day(4)), (1, "M", day(0), day(4)), (1, "M", day(0), day(6)), (1, "M", day(9), day(5)), (1, "M", None, day(4)), (1, "M", day(0), None), (2, "M", day(0), day(30))]
    r = universe.timing_audit(spark.createDataFrame(rows, "asset_id int, market string, end_date date, ann_date date"), bars, 10).first()
    assert (r.rows, r.missing_announcements, r.missing_periods, r.early_announcements, r.duplicate_rows, r.revised_periods) == (7, 1, 1, 1, 2, 1)
    assert (r.mapped_rows, r.unmapped_rows, r.early_signals, r.stale_signals) == (4, 1, 0, 2)
    assert r.blockers == "missing_announcements;missing_periods;early_announcements;duplicate_rows;stale_signals"


def test_prior_state_looks_back_only(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.05, 70).round(4)
    frame = spark.createDataFrame([("k", day(i), float(v)) for i, v in enumerate(x)], "k string, date date, period_return double")
    got = overlays.prior_state_risk(frame, ["k"], [("prior_sum_21", -0.1, 0.5)], ("prior_drawdown", -0.2, 0.0)).orderBy("date").collect()
    r = pd.Series(x)
    s21, prior = r.shift(1).rolling(21, min_periods=1).sum().fillna(0), (1 + r).cumprod().shift(1).fillna(1)
    dd = prior / prior.cummax() - 1
    exposure = np.where(s21 < -0.1, 0.5, np.where(dd < -0.2, 0.0, 1.0))
    assert [g.prior_sum_21 for g in got] == pytest.approx(list(s21), abs=1e-12) and [g.prior_drawdown for g in got] == pytest.approx(list(dd), abs=1e-12)
    assert [g.self_exposure for g in got] == list(exposure) and got[-1].equity == pytest.approx((1 + r * exposure).prod())


def test_market_state_grid_and_alignment(spark):
    rng = np.random.default_rng(5)
    r = pd.Series(rng.normal(0, 0.05, 40).round(4), index=[day(i * 2) for i in range(40)])
    bench = spark.createDataFrame([("M", d, float(v)) for d, v in r.items()], "market string, date date, period_return double")
    caps = overlays.market_state_caps(bench, ["market"], [5, 8], [0.0, -0.1], -0.15, [0.5, 0.25])
    got = {(x.lookback, x.threshold, x.cap_exposure, x.date): x.cap for x in caps.collect()}
    equity = (1 + r).cumprod()
    for n in (5, 8):
        for t in (0.0, -0.1):
            stress = (equity / equity.shift(n) - 1 <= t) | (equity / equity.rolling(n).max() - 1 <= -0.15)
            for c in (0.5, 0.25):
                want = stress.map({True: c, False: 1.0}).shift(1).fillna(1.0)
                assert all(got[n, t, c, d] == v for d, v in want.items())
    events = spark.createDataFrame([("M", day(11), day(12), 0.1), ("M", day(-3), day(1), 0.2), ("N", day(11), day(12), None)], "market string, decision_date date, date date, period_return double")
    out = overlays.align_caps(events, caps, ["market"], ["lookback", "threshold", "cap_exposure"]).collect()
    assert len(out) == 3 * 8
    for x in out:
        want = got[x.lookback, x.threshold, x.cap_exposure, day(10)] if (x.market, x.decision_date) == ("M", day(11)) else 1.0
        assert x.cap == want and x.capped_return == pytest.approx((x.period_return or 0.0) * want)


def test_hedged_spread(spark):
    own = spark.createDataFrame([("M", day(0), 0.05), ("M", day(1), None)], "market string, date date, period_return double")
    bench = spark.createDataFrame([("M", day(0), 0.01, 0.02), ("M", day(2), 0.03, None)], "market string, date date, period_return double, gross_return double")
    got = {r.date: r.period_return for r in overlays.hedged_spread(own, bench, ["market"], 0.5).collect()}
    assert got == {day(0): pytest.approx(0.05 - 0.5 * 0.03), day(1): 0.0, day(2): pytest.approx(-0.015)}


def test_breadth_bridge_by_pandas(spark):
    rng = np.random.default_rng(9)
    rows = [(day(d), "M", i, None if i == 3 else f"I{i % 5}", float(rng.normal()), float(rng.normal())) for d in range(4) for i in range(38)]
    out = {r.date: r for r in neutralize.breadth_bridge(spark.createDataFrame(rows, "date date, market string, asset_id int, industry string, factor_value double, forward_return double"), picked=2).collect()}
    pdf = pd.DataFrame(rows, columns=["date", "m", "a", "industry", "f", "r"]).dropna()
    for d, part in pdf.groupby("date"):
        rank = part.f.rank(pct=True)
        g = part.assign(rank=rank).groupby("industry").agg(rank=("rank", "mean"), top=("rank", lambda v: (v >= 0.8).mean()), low=("rank", lambda v: (v <= 0.2).mean()), r=("r", "mean")).reset_index()
        g["b"] = (g["rank"] + g.top - g.low).round(10)
        g = g.sort_values(["b", "industry"], ascending=[False, True])
        x = out[d]
        assert x.top_return == pytest.approx(g.r.head(2).mean()) and x.bottom_return == pytest.approx(g.r.tail(2).mean()) and x.all_return == pytest.approx(g.r.mean())
        assert x.industry_rank_ic == pytest.approx(g.b.rank().corr(g.r.rank())) and x.eligible and x.stocks == 37


def test_folds_and_increments(spark):
    rng = np.random.default_rng(2)
    rows = [("M", c, day(i), float(np.round(rng.normal(0.01 * c, 0.05), 4))) for c in range(2) for i in range(40)]
    curves = spark.createDataFrame(rows, "market string, case_no int, date date, period_return double")
    folds = spark.createDataFrame([("M", 0, day(0), day(19), day(20), day(29)), ("M", 1, day(10), day(29), day(50), day(60))], "market string, fold int, train_start date, train_end date, test_start date, test_end date")
    got = {(r.fold, r.case_no): r for r in robustness.fold_decisions(robustness.fold_metrics(curves, folds, ["market"], "case_no", 52.0), 0.0, -0.5, 0.5).collect()}
    sharpe = lambda x: x.mean() / x.std() * 52**0.5
    for c in range(2):
        x = np.array([r for _, k, _, r in rows if k == c])
        a, b = sharpe(x[:20]), sharpe(x[20:30])
        r = got[0, c]
        assert (r.train_sharpe, r.test_sharpe, r.degradation, r.stability) == tuple(pytest.approx(v) for v in (a, b, max(a - b, 0), b - max(a - b, 0)))
        assert r.reasons == ";".join(n for n, bad in (("test_sharpe_low", b < 0), ("degradation_high", a - b > 0.5)) if bad) and r.accepted == (r.reasons == "")
        assert "test_missing" in got[1, c].reasons
    cases = robustness.case_stability(spark.createDataFrame([got[k] for k in sorted(got)]), ["market"], "case_no").collect()
    assert all(x.folds == 2 and x.accepted_folds <= 1 for x in cases)
    inc = {r.span: r for r in robustness.incremental_metrics(curves.where("case_no = 0"), curves.where("case_no = 1"), ["market"], ["case_no"], 52.0).collect()}
    x, y = (np.array([r for _, k, _, r in rows if k == c]) for c in range(2))
    assert set(inc) == {"all", "2024"} and inc["all"].return_delta == pytest.approx(np.prod(1 + y) - np.prod(1 + x)) and inc["all"].sharpe_delta == pytest.approx(sharpe(y) - sharpe(x))
    fall = lambda v: (np.cumprod(1 + v) / np.maximum(np.maximum.accumulate(np.cumprod(1 + v)), 1) - 1).min()
    assert inc["all"].drawdown_delta == pytest.approx(fall(y) - fall(x))


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    rows = [(k, float(rng.integers(0, 9)) if rng.random() > 0.1 else None, float(rng.normal())) for k in "abc" for _ in range(50)] + [("d", None, 1.0)]
    frame = spark.createDataFrame(rows, "k string, x double, y double")
    got = {r.k: r for r in w.exact_quantiles(frame, ["k"], {"p10": (F.col("x"), 0.1), "p50": (F.col("x"), 0.5), "p99": (F.col("y"), 0.99), "p0": (F.col("y"), 0.0), "p100": (F.col("y"), 1.0)}).collect()}
    for k in "abc":
        x, y = (np.array([r[i] for r in rows if r[0] == k and r[i] is not None]) for i in (1, 2))
        assert (got[k].p10, got[k].p50, got[k].p99, got[k].p0, got[k].p100) == tuple(pytest.approx(v) for v in (np.quantile(x, 0.1), np.quantile(x, 0.5), np.quantile(y, 0.99), y.min(), y.max()))
    assert got["d"].p10 is None and got["d"].p99 == 1.0


def test_extreme_trades(spark):
    rows = [("M", i, day(i), day(i + 1), day(i + 3), v, 0.1 * i, 0.01 * v) for i, v in enumerate([0.1, -9.0, 7.0, 7.0, 6.0, -0.2])]
    summary, top = overlays.extreme_trades(spark.createDataFrame(rows, "market string, asset_id int, signal_date date, entry_date date, exit_date date, gross_return double, participation_rate double, weighted_return double"), ["market"], 5.0, 3)
    r = summary.first()
    assert (r.trades, r.extreme_trades, r.max_size, r.max_days) == (6, 4, 9.0, 2) and r.p99_size == pytest.approx(np.quantile([0.1, 9, 7, 7, 6, 0.2], 0.99)) and r.top_weighted_share == pytest.approx(9 / 29.3)
    assert [(x.place, x.asset_id) for x in top.orderBy("place").collect()] == [(1, 1), (2, 2), (3, 3)]


def test_false_discovery_of_real_p_values(spark, sf_dir):
    got = registry.QUERIES["false_discovery_ic"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) > 1000 and evaluate
    parts = {}
    for r in got:
        parts.setdefault((r.market, r.factor_name, r.horizon), []).append(r)
    for rows in parts.values():
        rows.sort(key=lambda r: (r.rank_ic_p_value, r.date))
        m, low = len(rows), 1.0
        for k in range(m, 0, -1):
            low = min(low, rows[k - 1].rank_ic_p_value * m / k)
            assert rows[k - 1].bh_p_value == pytest.approx(low) and rows[k - 1].bonferroni_p_value == pytest.approx(min(1.0, rows[k - 1].rank_ic_p_value * m))


def test_basket_flow_on_known_dates(spark):
    names = inputs.MONEYFLOW
    rows = [(a, day(d), 0.1 * a - 0.15, 0.1 * d, None, 0.5) for a in (1, 2) for d in (0, 40, 80)]
    ratios = spark.createDataFrame(rows, "asset_id int, date date, " + ", ".join(f"{n} double" for n in names))
    baskets = spark.createDataFrame([("F", 1, day(0), day(40), 0.25), ("F", 2, day(0), day(40), 0.75), ("F", 2, day(41), None, 1.0), ("G", 9, day(0), None, 1.0), ("H", 1, day(50), day(60), 1.0)], "fund_symbol string, asset_id int, known_date date, end_date date, weight double")
    got = {(r.fund_symbol, r.date): r for r in inputs.basket_flow(ratios, baskets).collect()}
    assert set(got) == {("F", day(0)), ("F", day(40)), ("F", day(80))}
    r = got["F", day(40)]
    assert r.constituent_count == 2 and r.etf_net_mf_amount_ratio == pytest.approx(0.25 * -0.05 + 0.75 * 0.05) and r.etf_net_mf_positive_weight == 0.75
    assert r.etf_extra_large_order_net_amount_ratio == 0 and r.etf_small_order_sell_pressure_low == -0.5 and got["F", day(80)].constituent_count == 1
    joined = asof.interval_join_by_month(ratios.select("asset_id", "date"), baskets, ["asset_id"], "date", "known_date", "end_date")
    plain = asof.interval_join(ratios.select("asset_id", "date"), baskets, ["asset_id"], "date", "known_date", "end_date")
    rows_of = lambda df: sorted(map(str, df.select(*plain.columns).collect()))
    assert rows_of(joined) == rows_of(plain)
