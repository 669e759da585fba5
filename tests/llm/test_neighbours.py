"""Posting lists against brute force: recall, exact scores, odd rows, repeated rows, many copies of one vector."""

import numpy as np
from pyspark.sql import functions as F

from quillon.llm import neighbours, queries


def search(frame, k=10, step=100):
    return neighbours.nearest(frame, neighbours.usable(F.col("embedding")), F.col("id") % step == 0, "vec_id", k=k)


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute(rows, k, step):
    """{(query id, vector): [(distance, id)]}."""
    good = [(i, v) for i, v in rows if i is not None and usable(v)]
    dim = max((len(v) for _, v in good), default=1)
    x = np.array([list(v) + [0.0] * (dim - len(v)) for _, v in good]).reshape(-1, dim)
    ids = np.array([i for i, _ in good])
    out = {}
    for n, (i, v) in enumerate(good):
        if i % step == 0:
            d = np.sqrt(((x - x[n]) ** 2).sum(axis=1))
            out[i, tuple(v)] = sorted((d[j], ids[j]) for j in range(len(good)) if ids[j] != i)[:k]
    return out


def rows_of(n=3000, dim=12, seed=4, spread=0.2):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(40, dim))
    return [(i, [float(x) for x in centers[i % 40] + spread * rng.normal(size=dim)]) for i in range(n)]


def test_recall_and_exact_scores(spark):
    for spread in (0.05, 5.0):
        rows = rows_of(spread=spread)
        got = search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
        true = {q: r for (q, _), r in brute(rows, 10, 100).items()}
        by_id = dict(rows)
        hits = 0
        for q, best in true.items():
            mine = sorted((r["rank"], r["id"], r["score"]) for r in got if r["query_id"] == q)
            assert [m[0] for m in mine] == list(range(1, 11))
            assert [m[1:] for m in mine] == sorted((m[1:] for m in mine), key=lambda m: (m[1], m[0]))
            for _, i, score in mine:
                assert abs(score - np.sqrt(((np.array(by_id[i]) - np.array(by_id[q])) ** 2).sum())) < 1e-12
            hits += len({m[1] for m in mine} & {i for _, i in best})
        assert hits >= 0.9 * 10 * len(true)


def test_recall_of_the_query(spark, sf_dir):
    got = queries.op11_neighbours(spark, sf_dir)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    true = [(q, int(i)) for (q, _), best in brute(rows, 10, 100).items() for _, i in best]
    assert neighbours.recall(got.select("query_id", F.col("vec_id").alias("id")), spark.createDataFrame(true, "query_id long, id long")) >= 0.9
    assert set(got.columns) >= {"query_id", "rank", "vec_id", "score"}


def test_clusters_prune_lists(spark):
    index = neighbours.Index(spark.createDataFrame(rows_of(6000, spread=0.02), "vec_id long, embedding array<double>"), neighbours.usable(F.col("embedding")), "vec_id", 10)
    assert len(index.lists.centroids) > 20
    x = np.array([v for _, v in rows_of(6000, spread=0.02)[::100]])
    visited = len(index.lists.visited(x)[0]) / len(x)
    assert visited < 0.5 * len(index.lists.centroids)
    counts = index.counts(index.posted)
    assert counts.max() <= 8 * counts.mean()


def test_boundary_vectors_are_replicated_not_returned_twice(spark):
    lists = neighbours.Lists(np.array([[0.0, 0.0], [1.0, 0.0], [9.0, 9.0]]))
    at = lists.assign(np.array([[0.5, 0.0], [0.1, 0.0], [9.0, 9.0]]))
    assert sorted(at[0][at[0] >= 0]) == [0, 1] and list(at[1][at[1] >= 0]) == [0] and list(at[2][at[2] >= 0]) == [2]
    got = search(spark.createDataFrame(rows_of(2000, 2, spread=1.0), "vec_id long, embedding array<double>")).collect()
    assert len(got) == len({(r["query_id"], r["id"]) for r in got}) == 200


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (100, [0.5]), (200, [0.0, 0.0]), (8, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({n: F.lit(1) for n in ("row", "list", "block", "chunk", "score", "variant")})
    got = search(frame).collect()
    assert {r["query_id"] for r in got} == {0, 100}
    for (q, _), best in brute(rows, 10, 100).items():
        assert [(r["score"], r["id"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == best
    empty = search(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert empty.collect() == []


def test_copies_repeated_rows_and_variants(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(1200)] + rows_of(300, 3)
    rows += [(100, [1.0, 2.0, 3.0])] * 3 + [(100, [5.0, 5.0, 5.0])]
    got = search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)).collect()
    want = brute(rows, 10, 100)
    hits = total = 0
    for q in {q for q, _ in want}:
        mine = [sorted((r["rank"], r["id"], r["score"]) for r in got if r["query_id"] == q and r["variant"] == v) for v in range(len([1 for i, _ in want if i == q]))]
        for m, (_, best) in zip(mine, sorted((v, b) for (i, v), b in want.items() if i == q)):
            assert len(m) == 10
            hits += len({s for _, _, s in m} & {d for d, _ in best})
            total += len({d for d, _ in best})
            assert [i for _, i, s in m if s == 0] == [i for d, i in best if d == 0]
    assert hits >= 0.9 * total


def test_split_lists_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 50)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 3)
    monkeypatch.setattr(neighbours, "RECALL", 1.0)
    rows = [(i, [1.0, 1.0]) for i in range(300)] + [(i + 1000, [float(i), 1.0]) for i in range(500)]
    got = search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5, step=20).collect()
    want = brute(rows, 5, 20)
    assert len(got) == 5 * len(want)
    share = sum((r["score"], r["id"]) in want[r["query_id"], tuple(dict(rows)[r["query_id"]])] for r in got) / len(got)
    assert share >= 0.95


def test_small_lists_still_give_k(spark, monkeypatch):
    """Tight clusters of four rows: the nearest list has too few, and the ratio is that of the probes' own neighbours."""
    monkeypatch.setattr(neighbours, "LIST_ROWS", 4)
    monkeypatch.setattr(neighbours, "FIT_ROWS", 4)
    monkeypatch.setattr(neighbours, "RECALL", 0.2)
    rng = np.random.default_rng(2)
    centers = 100 * rng.normal(size=(60, 5))
    rows = [(i, [float(x) for x in centers[i % 60] + 0.01 * rng.normal(size=5)]) for i in range(240)]
    got = search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=10, step=20).collect()
    assert {r["query_id"]: 0 for r in got}.keys() == {i for i in range(0, 240, 20)} and len(got) == 10 * 12
