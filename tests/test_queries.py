"""Every registered query against its SQL, on the smallest data."""

import pytest

from quillon.plans import composite_queries, core_queries, factor_queries, input_queries, landing_queries, peer_queries, portfolio_queries, repair_queries, report_queries, research_queries, residual_queries, robustness_queries, signal_queries, universe_queries  # noqa: F401
from quillon.plans import registry

from .compare import connect, spark_rows, sql_rows


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, sf_dir, con, name):
    assert spark_rows(registry.QUERIES[name](spark, sf_dir)) == sql_rows(con, registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_other_queries_run(spark, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)  # the smallest panel has too few assets for some of them
    assert df.columns and df.count() >= 0


def test_probabilistic_sharpe(spark):
    import math
    from statistics import NormalDist

    from quillon.operators import reports

    r = [0.02, -0.01, 0.03, 0.01, -0.02, 0.015]
    got = reports.probabilistic_sharpe(spark.createDataFrame([("k", x) for x in r], "k string, period_return double"), ["k"]).first()
    mean, n = sum(r) / 6, 6
    m2, m3, m4 = (sum((x - mean) ** k for x in r) / n for k in (2, 3, 4))
    s = mean / math.sqrt(m2 * n / (n - 1))
    var = 1 - m3 / m2**1.5 * s + (m4 / m2**2 - 1) / 4 * s * s
    assert got.psr == pytest.approx(NormalDist().cdf(s * math.sqrt(n - 1) / math.sqrt(var)))


def test_p_values_lie_between_0_and_1(spark, sf_dir):
    bad = registry.QUERIES["ic_p_values"](spark, sf_dir).where("ic_p_value not between 0 and 1 or rank_ic_p_value not between 0 and 1")
    assert bad.count() == 0


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0 and set(registry.QUERIES) <= set(entry.queries()) and set(registry.SQL) <= set(entry.oracle_sql())
