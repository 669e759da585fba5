"""Statements as of dates, industry and style residuals, closed-return risk, exclusions, delayed exits, index events, folds."""


import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.functions import windows as w
from quillon.operators import families, neutralize, overlays, statements

from .test_operators import bars, day


def test_statements_merge_by_version_and_null_keys(spark):
    key = "symbol string, ann_date date, end_date date, report_type string, comp_type string, end_type string, version int"
    k = ("A", day(9), day(0), "1", None, "q")
    income = spark.createDataFrame([(*k, 1, 5.0), (*k, 2, None), ("B", *k[1:], 1, 7.0)], key + ", netprofit double")
    balance = spark.createDataFrame([(*k, 1, 50.0, 20.0), (*k, 1, 50.0, 20.0)], key + ", total_assets double, total_liab double")
    cash = spark.createDataFrame([("C", *k[1:], 1, 3.0)], key + ", cash double")
    out = statements.merge_statements({"i": income, "b": balance, "c": cash}, {"i": ["netprofit"], "b": ["total_assets", "total_liab"], "c": ["cash"]}, "version")
    got = {r.symbol: (r.netprofit, r.total_assets, r.total_liab, r.cash) for r in out.collect()}
    assert got == {"A": (None, 50.0, 20.0, None), "B": (7.0, None, None, None), "C": (None, None, None, 3.0)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") <= 2 and "SortMergeJoin" not in plan


def test_revisions_are_unseen_before_their_day(spark):
    rows = [("A", day(0), day(30), "1", 1.0), ("A", day(0), day(60), "1", 2.0), ("A", day(0), day(90), "2", 3.0), ("A", day(0), day(10), "2", 0.5), ("B", day(0), None, "1", 9.0)]
    frame = spark.createDataFrame(rows, "symbol string, end_date date, ann_date date, report_type string, v double")
    versions = statements.known_versions(frame, F.col("report_type"), ["symbol"])
    dates = [day(5), day(10), day(29), day(30), day(59), day(60), day(200)]
    got = {r.as_of: r.v for r in statements.as_of(versions, dates).collect()}
    # kind 2 is shown until kind 1 comes, a later row of kind 2 never displaces kind 1
    assert got == {day(10): 0.5, day(29): 0.5, day(30): 1.0, day(59): 1.0, day(60): 2.0, day(200): 2.0}


def test_industry_style_residual_equals_dummy_regression(spark):
    rng = np.random.default_rng(2)
    rows = []
    for d in range(3):
        for i in range(60):
            a, b = rng.normal(), rng.normal()
            industry = None if i == 7 else f"I{i % 9}"
            y = None if i == 11 else 3 * (i % 9) + 0.5 * a - b + rng.normal()
            rows.append((i, "M", day(d), industry, y, a, b if i != 13 else None, 2 * a))
    rows += [(i, "M", day(9), "only", float(i), float(i % 3), 1.0, 0.0) for i in range(40)] + [(i, "M", day(10), f"I{i % 4}", 1.0, float(i), float(i * i), 0.0) for i in range(40)]
    frame = spark.createDataFrame(rows, "asset_id int, market string, date date, industry string, y double, a double, b double, c double")
    for styles in (["a", "b"], ["a", "c", "b"]):
        got = {(r.date, r.asset_id): r.residual for r in neutralize.industry_style_residual(frame, "y", styles).collect()}
        pdf = pd.DataFrame(rows, columns=["asset_id", "market", "date", "industry", "y", "a", "b", "c"])
        for date, part in pdf[pdf.date <= day(2)].groupby("date"):
            whole = part.dropna(subset=["industry", "y", *styles])
            z = lambda s: (s - s.mean()) / s.std(ddof=0)
            x = np.column_stack([pd.get_dummies(whole.industry, dtype=float), *[z(whole[s]) for s in styles]])
            y = z(whole.y).to_numpy()
            left = dict(zip(whole.asset_id, y - x @ np.linalg.lstsq(x, y, rcond=None)[0]))
            for i in part.asset_id:
                assert (got[date, i] is None) == (i not in left)
                if i in left:
                    assert got[date, i] == pytest.approx(left[i], abs=1e-9)
        assert all(got[d, i] is None for d in (day(9), day(10)) for i in range(40))  # too few industries; nothing varies


def closed_by_hand(rows, k, threshold, low):
    """Decisions in turn, with what has closed by then."""
    out, pending, closed = {}, [], []
    for d in sorted({r[0] for r in rows}):
        pending.sort()
        closed += [x[-1] for x in pending if x[0] <= d]
        pending = [x for x in pending if x[0] > d]
        prior = sum(closed[-k:])
        for decision, exit_, name, r in rows:
            if decision == d:
                out[decision, exit_, name] = (prior, low if prior < threshold else 1.0)
                pending.append((exit_, decision, name, r))
    return out


def test_closed_return_risk(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(120):
        d = int(rng.integers(0, 60))
        rows.append((day(d), day(d + int(rng.integers(0, 12))), i, float(np.round(rng.normal(0, 0.02), 4))))
    frame = spark.createDataFrame([("s", *r) for r in rows] + [("t", day(1), day(3), 0, None), ("t", day(2), None, 1, 0.1)], "series string, decision_date date, date date, n int, period_return double")
    got = overlays.closed_return_risk(frame, ["series"], 5, 0.0, 0.25, "n").collect()
    want = closed_by_hand(rows, 5, 0.0, 0.25)
    mine = {(r.decision_date, r.date, r.n): r for r in got if r.series == "s"}
    assert set(mine) == set(want)
    for key, (prior, exposure) in want.items():
        assert mine[key].prior_sum == pytest.approx(prior, abs=1e-12) and (abs(prior) < 1e-12 or mine[key].self_exposure == exposure)
    equity, peak = 1.0, 0.0
    for r in sorted(mine.values(), key=lambda r: (r.date, r.decision_date, r.n)):
        equity *= 1 + r.adjusted_return
        peak = max(peak, equity)
        assert r.equity == pytest.approx(equity) and r.drawdown == pytest.approx(equity / peak - 1, abs=1e-12)
    assert [(r.period_return, r.self_exposure) for r in got if r.series == "t"] == [(0.0, 1.0)]
    assert "BroadcastNestedLoopJoin" not in overlays.closed_return_risk(frame, ["series"], 5, 0.0, 0.25, "n")._jdf.queryExecution().executedPlan().toString()


def test_exclusion_totals_add_up(spark):
    trades = spark.createDataFrame([("M", day(1), 0.03, 9.0), ("M", day(1), -0.01, 9.0), ("M", day(2), 0.02, 1.0), ("M", day(7), -0.05, 9.0), ("M", None, 0.5, 9.0), ("M", day(3), None, 9.0)], "market string, exit_date date, weighted_return double, f double")
    template = spark.createDataFrame([("M", day(1), 0.05), ("M", day(2), 0.01), ("M", day(3), None), ("N", day(1), 0.2)], "market string, date date, period_return double")
    flagged = overlays.flagged_contributions(trades, overlays.within({"f": (5.0, None)}), ["market"])
    got = {(r.market, r.date): (round(r.period_return, 6), r.flagged_trades) for r in overlays.exclude_from_template(template, flagged, ["market"]).collect()}
    assert got == {("M", day(1)): (0.03, 2), ("M", day(2)): (0.01, 0), ("M", day(3)): (0.0, 1), ("N", day(1)): (0.2, 0)}
    r = overlays.unmatched_contributions(template, flagged, ["market"]).first()
    assert (r.flagged_trades, r.matched_trades, r.unmatched_trades) == (4, 3, 1)
    assert r.matched_contribution + r.unmatched_contribution == pytest.approx(0.03 - 0.01 - 0.05)
    assert r.unmatched_share == pytest.approx(0.05 / 0.09)


def test_delayed_exits(spark):
    sells = "YNNNYYYNNN"  # the history ends blocked
    mask = spark.createDataFrame([(1, day(i), 10.0 + i, s == "Y") for i, s in enumerate(sells)] + [(2, day(0), 0.0, True), (2, day(1), 5.0, True), (3, day(0), 5.0, True), (3, day(1), 0.0, True)], "asset_id int, date date, adj_close double, can_sell boolean")
    rows = [(1, 0, 0, True), (1, 0, 1, True), (1, 0, 4, True), (1, 0, 8, True), (1, 0, 1, False), (2, 0, 1, True), (3, 0, 1, True), (4, 0, 1, True), (1, 6, 6, None)]
    frame = spark.createDataFrame([(a, day(e), day(x), ok, 0.5, 0.001) for a, e, x, ok in rows], "asset_id int, entry_date date, exit_date date, entry_allowed boolean, target_weight double, cost_rate double").withColumn("n", F.monotonically_increasing_id())
    got = [r for r in overlays.delayed_exits(frame.coalesce(1), mask, 3).orderBy("n").collect()]
    status = [r.delayed_exit_status for r in got]
    assert status == ["same_day_exit", "delayed_exit", "same_day_exit", "unresolved_exit", "entry_blocked", "missing_entry_price", "missing_exit_price", "missing_entry_price", "same_day_exit"]
    late = got[1]
    assert (late.delayed_exit_date, late.exit_delay_days) == (day(4), 3) and late.delayed_gross_return == pytest.approx(14 / 10 - 1)
    assert late.delayed_weighted_return == pytest.approx((14 / 10 - 1 - 0.001) * 0.5)
    assert all(r.delayed_weighted_return == 0 and r.delayed_exit_date == r.exit_date for r in got if r.delayed_exit_status not in ("same_day_exit", "delayed_exit"))
    assert overlays.delayed_exits(frame, mask, 2).where("delayed_exit_status = 'unresolved_exit'").count() == 2


def test_index_events(spark):
    snaps = {0: {"a": 0.5, "b": 0.5}, 10: {"a": 0.3, "c": 0.7}, 20: {"a": 0.305, "c": 0.695}, 30: {"b": 1.0}}
    rows = [("X", day(d), m, wt) for d, s in snaps.items() for m, wt in s.items()] + [("Y", day(5), "z", 1.0)]
    frame = spark.createDataFrame(rows + [rows[0]], "index_code string, date date, symbol string, weight double")
    calendar = spark.createDataFrame([(day(i),) for i in (0, 10, 12, 30)], "date date")
    got = sorted((r.index_code, r.event_date, r.symbol, r.event_type, r.available_date, round(r.weight_change, 6)) for r in overlays.snapshot_changes(frame, 0.01, calendar=calendar).collect())
    assert got == [
        ("X", day(10), "a", "weight_changed", day(12), -0.2), ("X", day(10), "b", "removed", day(12), -0.5), ("X", day(10), "c", "added", day(12), 0.7),
        ("X", day(30), "a", "removed", None, -0.305), ("X", day(30), "b", "added", None, 1.0), ("X", day(30), "c", "removed", None, -0.695),
    ]


def test_rolling_mad_equals_pandas(spark):
    rng = np.random.default_rng(4)
    values = [None if i % 11 == 3 else float(np.round(rng.normal(), 3)) for i in range(60)]
    frame = spark.createDataFrame([(1, day(i), v) for i, v in enumerate(values)], "asset_id int, date date, v double")
    off = lambda x: float(np.median(np.abs(x[~np.isnan(x)] - np.median(x[~np.isnan(x)]))))
    series = pd.Series(values, dtype=float)
    for shift in (0, 1):
        want = series.shift(shift).rolling(9, min_periods=5).apply(off, raw=True)
        got = [r.m for r in frame.withColumn("m", w.mad("v", 9, 5, shift=shift)).orderBy("date").collect()]
        assert [g is None for g in got] == list(want.isna())
        assert [g for g in got if g is not None] == pytest.approx(list(want.dropna()))


def test_exponential_means_equal_pandas_without_python_workers(spark):
    rng = np.random.default_rng(6)
    values = [None, None] + [None if i % 7 == 5 else float(10 + rng.normal()) for i in range(80)]
    frame = spark.createDataFrame([(values,)], "v array<double>")
    got = frame.select(w.exponential(F.col("v"), 9, 9).alias("e")).first().e
    want = pd.Series(values, dtype=float).ewm(span=9, adjust=False, min_periods=9).mean()
    missing = [v is None for v in values]
    for g, x, gone in zip(got, want, missing):
        assert (g is None) == np.isnan(x) and (g is None or g == pytest.approx(x)), gone
    assert frame.select(w.exponential(F.array().cast("array<double>"), 9, 9).alias("e")).first().e == []
    plan = families.macd_histogram(bars(spark, {1: range(10, 60)}))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
