"""Repeated query rows, chunks that get only the blocks they visit, clashing columns."""

import numpy as np
from pyspark.sql import functions as F

from quillon.llm import topk


def rows_of(seed=2, n=1200, dim=6):
    rng = np.random.default_rng(seed)
    centers = 5 * rng.normal(size=(12, dim))
    return [(i, [float(x) for x in centers[i % 12] + 0.05 * rng.normal(size=dim)]) for i in range(n)]


def best(query, rows, k):
    q = np.floor(64 * np.array(query[1]))
    found = sorted((-int(np.floor(64 * np.array(v)) @ q), i) for i, v in rows if i != query[0])[:k]
    return [(n + 1, i, -s) for n, (s, i) in enumerate(found)]


def search(frame, k=20):
    return topk.top_k(frame, topk.scaled(F.col("embedding")), F.col("vec_id") % 20 == 0, "vec_id", k=k)


def test_repeated_queries_are_one_query(spark):
    rows = rows_of(n=100)
    rows += [rows[20]] * 5 + [(40, rows[41][1])]
    got = search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    for i, variants in ((0, 1), (20, 1), (40, 2), (60, 1)):
        mine = sorted({tuple(v) for j, v in rows if j == i})
        assert len(mine) == variants
        for n, v in enumerate(mine):
            assert sorted((r.rank, r.id, r.score) for r in got if r.query_id == i and r.variant == n) == best((i, v), rows, 20)


def test_chunks_get_the_blocks_they_visit(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    monkeypatch.setattr(topk, "QUERY_ROWS", 8)
    rows = rows_of()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({n: F.lit(1) for n in ("id", "vec", "block", "chunk", "score")})
    got = search(frame)
    for r in (0, 20, 600):
        assert sorted((x.rank, x.id, x.score) for x in got.where(F.col("query_id") == r).collect()) == best(rows[r], rows, 20)
    s = topk.Search(frame, topk.scaled(F.col("embedding")), F.col("vec_id") % 20 == 0, "vec_id")
    assert s.rings.chunks > 4 and s.rings.blocks > 10
    at = s.visits(s.with_floors(), False)
    assert s.sent(at).count() < 0.6 * s.rings.chunks * len(rows)
    pairs, sent = topk.visited_share(frame, topk.scaled(F.col("embedding")), F.col("vec_id") % 20 == 0, "vec_id")
    assert 0 < pairs <= sent < 0.6


def test_far_vectors_share_the_last_ring(spark):
    rows = rows_of(n=60) + [(60 + i, [1e4 * (i + 1)] + [0.0] * 5) for i in range(40)]
    got = search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=7).collect()
    for r in (0, 40, 80):
        assert sorted((x.rank, x.id, x.score) for x in got if x.query_id == r) == best(rows[r], rows, 7)
