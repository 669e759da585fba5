"""Dependency trees from sparse pair counts: as from dense tables, in Spark as in one place, with many voters."""

import math
import time
import tracemalloc

import numpy as np
import pyarrow as pa

from quillon.llm import queries
from quillon.llm import toxicity as t


def votes_of(rng, n, k):
    y = rng.random(n) < 0.3
    base = rng.random((n, k)) < np.where(y[:, None], rng.uniform(0.1, 0.5, k), rng.uniform(0.01, 0.2, k))
    for j in range(1, k, 2):  # every other voter mostly copies the one before
        base[:, j] = np.where(rng.random(n) < 0.8, base[:, j - 1], base[:, j])
    return y, base


def dense_tree(y, dense):
    """Prim's algorithm over full tables, for pairs that speak together."""
    n, k = dense.shape
    gain = np.full((k, k), -np.inf)
    for i in range(k):
        for j in range(k):
            if i != j and (dense[:, i] & dense[:, j]).any():
                g = 0.0
                for c in (False, True):
                    rows = dense[y == c]
                    for a in (0, 1):
                        for b in (0, 1):
                            seen = ((rows[:, i] == a) & (rows[:, j] == b)).sum()
                            if seen:
                                g += seen * math.log(seen * len(rows) / ((rows[:, i] == a).sum() * (rows[:, j] == b).sum()))
                gain[i, j] = g
    bar = math.log(max(2, k * (k - 1) / 2)) + 1
    edges, todo = set(), set(range(k))
    while todo:
        tree = {min(todo)}
        while True:
            best = max(((gain[i, j], i, j) for i in tree for j in todo - tree), default=(-np.inf,))
            if best[0] <= bar:
                break
            edges.add(frozenset(best[1:]))
            tree.add(best[2])
        todo -= tree
    return edges


def edges_of(parent):
    return {frozenset((i, int(p))) for i, p in enumerate(parent) if p >= 0}


def test_same_trees_as_dense_tables(spark):
    for seed in range(4):
        y, dense = votes_of(np.random.default_rng(seed), 400, 12)
        votes, said = np.nonzero(dense)
        local = t.dependencies(votes, said, 400, 12, y.astype(float))
        assert edges_of(local) == dense_tree(y, dense)
        frame = spark.createDataFrame([([int(i) for i in np.flatnonzero(r)], bool(c)) for r, c in zip(dense, y)], "hits array<int>, toxic boolean").repartition(5)
        on = np.array([dense[y == c].sum(axis=0) for c in (False, True)], dtype=float)
        assert (t.tree_of(frame, 12, on, np.array([(~y).sum(), y.sum()])) == local).all()


def test_trees_hang_from_their_first_voter():
    parent = t.rooted(np.array([3, 1, 5]), np.array([4, 3, 6]), 8)
    assert parent.tolist() == [-1, -1, -1, 1, 3, -1, 5, -1]


def test_long_rows_are_counted_in_slices():
    rows = [(np.arange(40), 1.0), (np.arange(0, 40, 2), 0.0), (np.array([5]), 1.0), (np.array([], dtype=int), 0.0)]
    want = {}
    for said, q in rows:
        for a in range(len(said)):
            for b in range(a + 1, len(said)):
                p = want.setdefault(int(said[a]) * 40 + int(said[b]), [0.0, 0.0])
                p[0 if q else 1] += 1
    got = {}
    for code, toxic, clean in t.pair_counts(iter(rows), 40, most=100, slice_=7):
        for c, x, z in zip(code.tolist(), toxic, clean):
            p = got.setdefault(c, [0.0, 0.0])
            p[0], p[1] = p[0] + x, p[1] + z
    assert got == want


def test_twenty_thousand_voters_on_the_driver(spark):
    rng, k, n = np.random.default_rng(7), 20_000, 30_000
    toxic = rng.random(n) < 0.2
    rows = [np.unique(np.concatenate([rng.integers(0, k, 30), b := rng.integers(0, k // 10, 6) * 10, b + 1])) for _ in range(n)]
    table = pa.table({"hits": pa.array([r.astype(np.int32) for r in rows], pa.list_(pa.int32())), "toxic": toxic})
    frame = spark.createDataFrame(table).repartition(8)
    votes, said = np.repeat(np.arange(n), [len(r) for r in rows]), np.concatenate(rows)
    gold = toxic.astype(float)
    on = np.array([np.bincount(said, weights=w[votes], minlength=k) for w in (1 - gold, gold)])
    tracemalloc.start()
    began = time.time()
    parent = t.tree_of(frame, k, on, np.array([n - gold.sum(), gold.sum()]))
    t.label_model(votes, said, n, k, gold, rounds=3, parent=parent)
    took, peak = time.time() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert took < 60 and peak < 500e6
    assert np.mean([parent[i + 1] == i or parent[i] == i + 1 for i in range(0, k, 10)]) > 0.9


def test_query_against_a_version_by_hand(spark, sf_dir):
    """Rows, classes and scores of the query, with features found anew and the weights of the fitted model."""
    import re
    import zlib

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = t.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = {r.doc_id: r for r in queries.op1_toxicity(spark, sf_dir).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        words = re.findall(r"[^\W\d_]+", (r.text or "").lower())
        z = model.intercept + sum(model.weights.get(w, 0.0) for w in set(words))
        for k in (3, 4, 5, 6, 7):
            starts = [w[:k] for w in words if len(w) > k]
            for s in set(starts):
                n = starts.count(s)
                z += model.weights.get(s + "*", 0.0)
                if n >= 0.01 * len(words):
                    z += model.weights.get(s + "*%", 0.0) + (model.weights.get(s + "*%%", 0.0) if n > 1 else 0.0)
        assert abs(got[r.doc_id].score - 1 / (1 + math.exp(-max(-60, min(60, z))))) < 1e-9
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and got[r.doc_id].predicted == (got[r.doc_id].score >= 0.7)
