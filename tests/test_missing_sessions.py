"""Every market's missing sessions are reported."""

from quillon.sources import store


def test_every_market_is_compared(spark):
    rows = [("A", "2020-01-01"), ("A", "2020-01-02"), ("B", "2020-01-01"), ("B", "2020-01-03"), ("C", "2020-01-01"), ("C", "2020-01-02"), ("C", "2020-01-03"), ("C", "2020-01-03")]
    got = store.missing_sessions(spark.createDataFrame(rows, "market string, date string")).collect()
    assert sorted(map(tuple, got)) == [("A", "2020-01-03"), ("B", "2020-01-02")]
    assert store.missing_sessions(spark.createDataFrame([], "market string, date string")).count() == 0
