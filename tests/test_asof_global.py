"""Rows meet states by date, and repeated states do not multiply or empty them."""

from quillon.operators import asof


def test_rows_are_joined_by_date(spark):
    rows = spark.createDataFrame([(1, 5), (2, 5), (3, 1), (4, 9), (5, None), (5, 9)], "n int, day int")
    states = spark.createDataFrame([(2, "a"), (6, "b"), (6, "c"), (2, "a")], "at int, state string")
    got = asof.asof_global(rows, states, "day", "at", ["state"])
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [(1, 5, 2, "a"), (2, 5, 2, "a"), (3, 1, None, None), (4, 9, 6, "c"), (5, None, None, None), (5, 9, 6, "c")]))
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
