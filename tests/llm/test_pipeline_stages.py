"""Mixing and sharding stages by hand, and the pipeline on odd input."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import queries, sharding

from .test_sharding_copies import by_hand


def test_mixing_stage_emits_what_the_sql_takes(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = dict(corpus_pipeline.STAGES)["mixing"](spark, docs, sf_dir)
    assert out.columns == docs.columns
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = {i: n for i, n in con.execute(f"SELECT doc_id, copies FROM ({queries._OP3_SQL})").fetchall() if n}
    assert Counter(r.doc_id for r in out.select("doc_id").collect()) == Counter(want)


def test_sharding_stage_by_hand(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 3 > 0")
    docs = docs.union(docs.where("doc_id < 20"))
    rows = dict(corpus_pipeline.STAGES)["sharding"](spark, docs, sf_dir).collect()
    slots = {r.doc_id: r.s for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", sharding.text_crc(F.col("text"))), F.lit(4096)).alias("s")).collect()}
    stats = {}
    for r in rows:
        assert r.virtual_slot == slots[r.doc_id]
        b, n = stats.get(r.virtual_slot, (0, 0))
        stats[r.virtual_slot] = (b + len((r.text or "").encode()) + 8, n + 1)
    where = by_hand(stats, 24)
    assert len(rows) == docs.count() and all(r.shard == where[r.virtual_slot] for r in rows)


ODD = [(1, None, "en", "a", 0), (2, "", None, None, None), (3, "one two", "en", "a", 7), (3, "one two", "en", "a", 7), (None, "lonely words", "en", "b", 1), (4, "long " * 50_000, "en", "a", 1), (5, "!!!", "en", "b", 3)]


@pytest.mark.parametrize("rows", [ODD, []])
def test_pipeline_on_odd_documents(spark, sf_dir, tmp_path, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"copies": F.lit("mine"), "size": F.lit("mine"), "score": F.lit("mine"), "slot": F.lit("mine")})
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # NULL and empty texts are near-duplicates of each other, and so are equal rows; texts without words are mixed as their source is
    assert {r.doc_id for r in out} <= {1, 3, None, 4, 5} and (not rows or {3, 4} <= {r.doc_id for r in out})
    assert all(r["copies"] == r["size"] == r["score"] == r["slot"] == "mine" and 0 <= r.shard < 24 for r in out)
