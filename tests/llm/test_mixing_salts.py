"""Salts grow with the rows; rows without an id are spread by their texts."""

from collections import Counter

from pyspark.sql import functions as F

from quillon.llm import mixing


def test_many_cells_and_missing_ids(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL_ROWS", 4)
    frame = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.concat(F.lit("w"), (F.col("id") % 500).cast("string")), (F.col("id") % 5 + 1).cast("int"))).alias("text"), F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, "b").alias("source"), F.lit(1).alias("copies"), F.lit(2).alias("__salt"))
    rows = mixing.mix(frame).collect()
    taken, target = Counter(), {}
    for r in rows:
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
        assert r["__salt"] == 2 and 0 <= r.copies <= 3
    assert len(rows) == 6000 and all(abs(taken[s] - target[s]) <= 11 for s in target)
    again = Counter((r.doc_id, r.text, r.copies) for r in mixing.mix(frame.repartition(5)).collect())
    assert sum(again.values()) == 6000 and Counter({k: v for k, v in again.items() if k[0] is not None}) == Counter((r.doc_id, r.text, r.copies) for r in rows if r.doc_id is not None)
