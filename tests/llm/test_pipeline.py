"""The pipeline stage by stage against brute force on its own inputs."""

import corpus_pipeline
from quillon.llm import toxicity

from . import helpers as h


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    stages = dict(corpus_pipeline.STAGES)
    rows = {r.doc_id: r for r in docs.collect()}

    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    clean = stages["toxicity"](spark, docs, sf_dir)
    want = {i for i, r in rows.items() if (model.score(r.text, {}) if model else 0.0) < 0.7}
    assert {r.doc_id for r in clean.collect()} == want and clean.columns == docs.columns

    unique = stages["near_duplicates"](spark, docs, sf_dir)
    prints = [h.simhash(r.text) for r in rows.values()]
    parts = h.components(list(rows), prints)
    assert sorted(r.doc_id for r in unique.collect()) == sorted(set(parts)) and unique.columns == docs.columns

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in stages["decontamination"](spark, docs, sf_dir).collect()}
    for i in list(rows)[:40] + [i for i in rows if i not in kept][:10]:
        n, hit, _ = h.contamination(rows[i].text, items)
        assert (i in kept) == (not (hit > 0 and 20 * hit >= n))


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "text", "lang", "source", "n_chars", "shard"} <= set(out.columns)
    assert out.count() > 50 and out.where("shard not between 0 and 23").count() == 0
