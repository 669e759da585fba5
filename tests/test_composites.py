"""Composite scores on rows made by hand."""

import datetime

import numpy as np
import pytest

from quillon.operators import composites as c

DAY = datetime.date(2024, 1, 5)


def rows(spark, name, values):
    return spark.createDataFrame([(i, "M", DAY, v) for i, v in enumerate(values)], f"asset_id long, market string, date date, {name} double")


def test_bridge_joins_ranks(spark):
    anti = rows(spark, "anti_obv_breakout_low_tail_20", [3.0, 1.0, 2.0, None])
    smart = rows(spark, "smart_money_reversal_value_20", [0.2, 0.2, 0.9, 0.4, 0.1])
    got = {r.asset_id: tuple(r)[3:] for r in c.risk_filter_bridge(anti, smart).collect()}
    ranks = {0: (3 / 3, 2.5 / 5), 1: (1 / 3, 2.5 / 5), 2: (2 / 3, 5 / 5)}
    assert set(got) == set(range(5)) and got[3] == got[4] == (None, None, None)
    for i, (a, b) in ranks.items():
        assert got[i] == pytest.approx(((a + b) / 2, min(a, b), 0.65 * a + 0.35 * b))


def test_bridge_needs_two_values(spark):
    got = c.risk_filter_bridge(rows(spark, "anti_obv_breakout_low_tail_20", [1.0]), rows(spark, "smart_money_reversal_value_20", [1.0])).first()
    assert tuple(got)[3:] == (None, None, None)


def panel(spark, assets=9, days=30):
    rng = np.random.default_rng(3)
    bars, flows = [], []
    for a in range(assets):
        p = 10.0
        for d in range(days):
            p *= 1 + rng.normal(0, 0.02)
            day = DAY + datetime.timedelta(d)
            bars.append((a, "M", day, float(p), float(rng.uniform(50, 150))))
            if a < assets - 1:
                flows.append((a, "M", day, float(rng.normal())))
    return spark.createDataFrame(bars, "asset_id long, market string, date date, adj_close double, amount double"), spark.createDataFrame(flows, "asset_id long, market string, date date, large_order_net_amount_ratio double")


def test_flow_combinations_against_numpy(spark):
    bars, flows = panel(spark)
    names = ("large_resid_liq_vol_amt_20", "large_resid_liq_vol_amt_gate_20", "large_liquidity_gate_20")
    got = c.flow_combinations(bars, flows, names, floor=100.0).toPandas().set_index(["asset_id", "date"]).sort_index()
    assert len(got) == 8 * 30  # the asset without flows is left out
    b = bars.toPandas().sort_values(["asset_id", "date"])
    ret = b.groupby("asset_id").adj_close.pct_change()
    b["liq"] = (ret.abs() / b.amount).groupby(b.asset_id).transform(lambda x: x.rolling(20).mean())
    b["vol"] = ret.groupby(b.asset_id).transform(lambda x: x.rolling(20).std(ddof=0))
    b["amt"] = np.log1p(b.amount)
    last = b[b.date == b.date.max()].set_index("asset_id")
    z = lambda x: (x - x.mean()) / x.std(ddof=0)
    xs = last[["liq", "vol", "amt"]].apply(z).loc[:7]
    f = flows.toPandas()
    y = z(f[f.date == f.date.max()].set_index("asset_id").large_order_net_amount_ratio)
    design = np.column_stack([np.ones(8), xs])
    want = y - design @ np.linalg.lstsq(design, y, rcond=None)[0]
    day = got.xs(b.date.max(), level="date")
    assert day.large_resid_liq_vol_amt_20.to_numpy() == pytest.approx(want.to_numpy(), abs=1e-9)
    assert day.large_resid_liq_vol_amt_gate_20.isna().tolist() == (last.amount.loc[:7] < 100).tolist()
    assert day.large_liquidity_gate_20.isna().tolist() == (xs.liq > xs.liq.median()).tolist()


def test_unknown_combination(spark):
    with pytest.raises(ValueError):
        c.flow_combinations(*panel(spark, 3, 3), names=("other",))
