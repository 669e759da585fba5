"""Macro states, correlations by state, snapshots of signals, guards from a reference table."""

import numpy as np
import pytest

from quillon.operators import overlays, states

from .test_operators import day


def test_states_repair_gaps_and_compare_with_the_release_before(spark):
    rows = [(day(0), None), (day(10), 3.0), (day(20), None), (day(30), 3.4), (day(40), 3.38), (day(50), 2.0), (day(50), 1.0)]
    got = [(r.release_date, r.rate, r.repaired, r.state) for r in states.macro_states(spark.createDataFrame(rows, "release_date date, rate double"), 0.05).orderBy("release_date").collect()]
    assert got == [(day(10), 3.0, False, "unknown"), (day(20), 3.0, True, "flat"), (day(30), 3.4, False, "tightening"), (day(40), 3.38, False, "flat"), (day(50), 2.0, False, "easing")]


def test_correlations_by_the_state_known_on_the_date(spark):
    ic = [("M", day(i), v) for i, v in enumerate([0.1, 0.2, -0.1, 0.3, None, 0.5, 0.4])]
    known = spark.createDataFrame([(day(1), "easing"), (day(4), "flat")], "release_date date, state string")
    got = {r.state: r for r in states.state_conditioned_ic(spark.createDataFrame(ic, "market string, date date, rank_ic double"), known, ["market"]).collect()}
    parts = {"unknown": [0.1, 0.2], "easing": [-0.1, 0.3], "flat": [0.5, 0.4]}  # a release counts from the day after
    assert set(got) == set(parts)
    for name, x in parts.items():
        r = got[name]
        assert (r.n, r.positive_rate) == (len(x), np.mean(np.array(x) > 0)) and r.mean_ic == pytest.approx(np.mean(x))
        assert r.t_stat == pytest.approx(np.mean(x) / np.std(x, ddof=1) * len(x) ** 0.5)


def test_a_snapshot_sees_no_later_rows(spark):
    factors = spark.createDataFrame([("M", "f", day(d), a, v) for d, a, v in [(0, 1, 9.0), (5, 1, 1.0), (5, 2, 3.0), (5, 3, 3.0), (5, 4, None), (9, 1, 99.0)]], "market string, factor_name string, date date, asset_id int, factor_value double")
    bars = spark.createDataFrame([(1, day(1), 10.0), (2, day(6), 20.0), (2, day(9), 99.0)], "asset_id int, date date, adj_close double")
    got = sorted((r["rank"], r.asset_id, r.signal_date, r.weight, r.price, r.stale) for r in states.signal_snapshot(factors, bars, str(day(7)), 2, 0.3, 1).collect())
    assert got == [(1, 2, day(5), 0.3, 20.0, True), (2, 3, day(5), 0.3, None, True)]
    assert states.signal_snapshot(factors, bars, str(day(-1)), 2, 0.3, 1).collect() == []


def test_reference_riskoff(spark):
    curve = spark.createDataFrame([("M", day(0), 0.1), ("M", day(1), None), ("M", day(2), 0.2)], "market string, date date, period_return double")
    reference = spark.createDataFrame([("M", day(0), True), ("M", day(0), False), ("M", day(1), None)], "market string, date date, riskoff boolean")
    got = {r.date: (r.riskoff, r.guarded_return) for r in overlays.reference_riskoff(curve, reference, ["market"], 0.5).collect()}
    assert got == {day(0): (True, 0.05), day(1): (False, 0.0), day(2): (False, 0.2)}
