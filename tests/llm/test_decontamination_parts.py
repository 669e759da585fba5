"""A benchmark of many parts: one automaton at a time, and the same hits."""

import random

from quillon.llm import decontaminate

from . import helpers as h


def test_one_automaton_at_a_time(spark, monkeypatch):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate([5, 60, 20, 2, 14, 30])]
    texts = [" ".join(rng.choice(vocab) for _ in range(30)) + " " + " ".join(items[i % 6][1].split()[i : i + 25]) for i in range(24)] + [None, items[1][1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate.parts, "__defaults__", (40,))
    scanned = decontaminate.scan(docs, bench)
    assert scanned._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    rows = scanned.collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, hit, found = h.contamination(r.text, items)
        assert (r.hits.n_words, r.hits.n_hit, list(r.hits["items"])) == (n, hit, found)


def test_pieces_hold_every_window():
    for n in (0, 1, 12, 13, 14, 25, 26, 27, 100):
        seq = list(range(n))
        cut = list(decontaminate.pieces(seq, 20, 13))
        assert all(len(x) <= 20 for x in cut)
        assert {tuple(x[i : i + 13]) for x in cut for i in range(max(1, len(x) - 12))} == {tuple(seq[i : i + 13]) for i in range(max(1, n - 12))}
