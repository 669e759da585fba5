"""Equal items are one entry; parts write hits, not documents."""

import glob
import os
import random
import time

from pyspark.sql import functions as F

from quillon.llm import common, decontaminate

from . import helpers as h


def test_equal_short_items_cost_what_one_costs():
    text = [b"yes", b"no"] * 40_000
    def took(copies):
        automaton = decontaminate.Automaton([([str(i)], [b"yes"]) for i in range(copies)])
        began = time.time()
        spans, found = automaton.scan(text)
        assert len(spans) == 40_000 and len(found) == copies
        return time.time() - began
    one, many = min(took(1) for _ in range(3)), min(took(2000) for _ in range(3))
    assert many < 3 * one + 0.2


def test_equal_items_in_many_parts(spark, monkeypatch, tmp_path):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(30)]
    bodies = [" ".join(rng.choice(vocab) for _ in range(n)) for n in (4, 40, 18, 1, 13, 25)]
    items = [(f"i{k}", bodies[k % 6].upper() if k % 2 else bodies[k % 6] + " !") for k in range(60)] + [(None, bodies[1]), ("blank", " ."), ("null", None)]
    texts = [" ".join(rng.choice(vocab) for _ in range(25)) + " " + bodies[i % 6] for i in range(30)] + ["", None, "nothing here"]
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, items int, number string").withColumn("__found", F.lit(2)).repartition(4)
    bench = spark.createDataFrame(items, "item_id string, text string")
    monkeypatch.setattr(decontaminate.parts, "__defaults__", (30,))
    folder = common.shared_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/documents-*")), set(glob.glob(f"{folder}/hits-*"))
    scanned = decontaminate.scan(docs, bench)
    assert scanned.columns == [*docs.columns, "hits"]
    made = set(glob.glob(f"{folder}/documents-*")) - before[0], set(glob.glob(f"{folder}/hits-*")) - before[1]
    assert [len(m) for m in made] == [1, 1] and not glob.glob(f"{folder}/automata-*")
    assert spark.read.parquet(made[1].pop()).columns == ["__number", "items", "spans"] and os.path.isdir(made[0].pop())
    clean = [(i, b) for i, b in items if b]
    rows = scanned.collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, hit, found = h.contamination(r.text, clean)
        assert (r.hits.n_words, r.hits.n_hit, list(r.hits["items"])) == (n, hit, found)
        assert sum(b - a + 1 for a, b in r.hits.spans) == hit
