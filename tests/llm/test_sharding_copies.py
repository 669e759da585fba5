"""Repeated rows, stored versions, placement by hand."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quillon.llm import queries, sharding


def by_hand(stats, shards):
    """The edit of version 0: slots from the largest down; one stays if it fits below the mean, else the emptiest shard takes it."""
    total, load, out = sum(b for b, _ in stats.values()), [0] * shards, {}
    for slot in sorted(stats, key=lambda s: (-stats[s][0], s)):
        at = slot % shards
        if (load[at] + stats[slot][0]) * shards > total:
            at = load.index(min(load))
        load[at] += stats[slot][0]
        out[slot] = at
    return out


def test_placement_and_numbers_by_hand(spark, sf_dir):
    rows = queries.op6_sharding(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    slots = {r.doc_id: r.s for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", sharding.text_crc(F.col("text")), F.lit(0).cast("long")), F.lit(4096)).alias("s")).collect()}
    stats = {}
    for r in rows:
        assert r.virtual_slot == slots[r.doc_id]
        b, n = stats.get(r.virtual_slot, (0, 0))
        stats[r.virtual_slot] = (b + r["size"], n + 1)
    where = by_hand(stats, 24)
    assert all(r.shard == where[r.virtual_slot] for r in rows)
    order = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.shard, r.virtual_slot, r.doc_id)):
        order[r.shard].append(r.slot)
    assert all(x == list(range(len(x))) for x in order.values())


def test_repeated_rows_are_spread(spark, tmp_path):
    spark.range(200_000).selectExpr("7L AS doc_id", "'x' AS text", "'s' AS source").union(spark.range(50).selectExpr("id", "'yy'", "'s'")).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op6_sharding(spark, str(tmp_path)).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("top")).collect()
    mean = sum(r.b for r in rows) / 24
    assert len(rows) == 24 and all(abs(r.b - mean) <= 10 for r in rows)
    assert all(r.n == r.d == r.top + 1 for r in rows)


def test_versions_are_stored_and_edited(spark, tmp_path):
    path = f"{tmp_path}/map"
    stats = spark.createDataFrame([(s, 10 * (s % 7 + 1), s % 7 + 1) for s in range(100)], "slot int, bytes long, rows long")
    sharding.save_map(sharding.first_map(stats, 4), path)
    one = {r.slot: r.shard for r in sharding.stored_map(stats, 4, path).collect()}
    grown = stats.where("slot <> 5").union(spark.createDataFrame([(200, 40, 4)], stats.schema))
    two = sharding.stored_map(grown, 5, path)
    now = {r.slot: r.shard for r in two.collect()}
    assert two.first().version == 2 and {r.slot: r.shard for r in sharding.load_map(spark, path, 1).collect()} == one
    assert set(now) == set(range(100)) | {200} and set(now.values()) == set(range(5))
    load = Counter()
    for r in two.collect():
        load[r.shard] += r.bytes
    assert max(load.values()) - min(load.values()) <= 70
    size = {r.slot: r.bytes for r in two.collect()}
    assert sum(size[s] for s in one if now[s] != one[s]) <= 0.3 * sum(size.values())  # a fifth has to move


def test_clashing_columns_and_odd_rows(spark):
    rows = [(1, None, 5), (1, None, 5), (None, "", 6), (None, None, 6), (2, "é" * 1000, 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, slot int").withColumns({"shard": F.lit("mine"), "__key": F.lit(1), "copy": F.lit(9)})
    told = sharding.with_copy(frame, [F.col("doc_id"), F.col("text")], out="__copy")
    keys = [F.col("doc_id"), F.col("__copy")]
    out = sharding.number(told, keys, sharding.build_map(told, keys, sharding.record_bytes(F.col("text")), 3), [F.col("doc_id")])
    assert out.count() == 5 and out.where("__key = 1 and copy = 9 and shard between 0 and 2").count() == 5
