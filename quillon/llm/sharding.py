"""Sharding by fixed virtual slots.

Every record hashes into one of ``n_slots`` virtual slots. Bytes and rows are aggregated per slot, and a versioned
slot-to-shard map says where each slot lives: version 0 deals the slots out in turn, every later version is an edit of
the one before that moves slots away from full shards. Only the map (``n_slots`` rows, whatever the corpus) is ever
gathered or broadcast; the records are numbered slot by slot, so no task holds a shard. Versions are stored in the shared
folder and read back from there (stored_map()).

Rows with equal keys would make their slot hot. with_copy() numbers such rows by their place in the input; with that
number among the keys they spread over all slots. As they are equal, it doesn't matter which of them goes where. Numbers
are shared by few to many rows, so that there are small slots, with which rebalancing levels the last differences.

Defined results: a NULL text has no bytes and checksum 0; an empty one likewise, apart from the fixed overhead both
pay; a NULL doc_id hashes like any other value; equal rows get numbers of their own, and slots of their own after with_copy(); an empty table
gives no rows; columns of the caller are kept unless an output has their name, and the working columns avoid their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh_path, temp_name

N_SLOTS = 4096
ROW_OVERHEAD = 8


def record_bytes(text: Column, overhead: int = ROW_OVERHEAD) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(overhead)).cast("long")


def text_crc(text: Column) -> Column:
    return F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long")


def slot_of(keys: list[Column], n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n_slots)).cast("int")


def slot_stats(df: DataFrame, slot: str, size: Column) -> DataFrame:
    """Bytes and rows of each slot: (slot, bytes, rows)."""
    return df.groupBy(F.col(slot).alias("slot")).agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("rows"))


def first_map(stats: DataFrame, n_shards: int) -> DataFrame:
    """Version 0 of the map: slots dealt out in turn."""
    return stats.select(F.lit(0).alias("version"), "slot", F.pmod("slot", F.lit(n_shards)).cast("int").alias("shard"), "bytes", "rows")


def rebalance(slot_map: DataFrame, n_shards: int) -> DataFrame:
    """The next version of a map, with shard sizes near equal.

    Slots are looked at from the largest to the smallest. A slot stays where it is while its shard has room for it below
    the mean size, else it moves to the shard that is emptiest by then. ``n_shards`` may differ from the map's: slots of
    shards that no longer exist move, new shards start empty.
    """
    entry = F.struct((-F.col("bytes")).alias("neg"), "slot", "shard", "rows")
    one = slot_map.groupBy().agg(F.sort_array(F.collect_list(entry)).alias("slots"), F.sum("bytes").alias("total"), F.max("version").alias("version"))
    placed = F.expr(f"""
        aggregate(
            slots,
            named_struct('load', array_repeat(0L, {n_shards}), 'out', cast(array() as array<int>)),
            (acc, s) -> element_at(transform(
                array(if(s.shard < {n_shards} and (coalesce(try_element_at(acc.load, s.shard + 1), 0L) - s.neg) * {n_shards} <= total,
                         s.shard,
                         cast(array_position(acc.load, array_min(acc.load)) - 1 as int))),
                c -> named_struct('load', transform(acc.load, (b, i) -> if(i = c, b - s.neg, b)), 'out', concat(acc.out, array(c)))
            ), 1),
            acc -> acc.out)
    """)
    pairs = F.explode(F.arrays_zip(F.col("slots"), placed.alias("to"))).alias("z")
    return one.select((F.col("version") + 1).alias("version"), pairs).select("version", F.col("z.slots.slot").alias("slot"), F.col("z.to").alias("shard"), (-F.col("z.slots.neg")).alias("bytes"), F.col("z.slots.rows").alias("rows"))


def save_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the stored map; earlier versions stay readable."""
    slot_map.write.partitionBy("version").mode("append").parquet(path)


def load_map(spark, path: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, the latest one by default."""
    stored = spark.read.schema("slot int, shard int, bytes long, rows long, version int").parquet(path)  # no table, no files
    wanted = version if version is not None else stored.agg(F.max("version")).first()[0] or 0
    return stored.where(F.col("version") == wanted).select("version", "slot", "shard", "bytes", "rows")


def stored_map(stats: DataFrame, n_shards: int, path: str | None = None) -> DataFrame:
    """The latest version of the map after a rebalancing edit, read from where its versions are stored.

    Without stored versions at ``path``, or without a path, version 0 is stored first.
    """
    spark = stats.sparkSession
    if path is None:
        path = fresh_path(spark, "slot-map")
        save_map(first_map(stats, n_shards), path)
    last = load_map(spark, path)
    now = last.select("version", "slot", "shard").join(stats, "slot", "outer")
    version = F.coalesce("version", F.max("version").over(Window.partitionBy(F.lit(0))), F.lit(0))  # at most n_slots rows
    held = now.select(version.alias("version"), "slot", F.coalesce("shard", F.pmod("slot", F.lit(n_shards)).cast("int")).alias("shard"), F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("rows", F.lit(0)).alias("rows"))
    save_map(rebalance(held, n_shards), path)
    return load_map(spark, path)


def build_map(df: DataFrame, keys: list[Column], size: Column, n_shards: int, n_slots: int = N_SLOTS, path: str | None = None) -> DataFrame:
    (slot,) = temp_name(df, "slot")
    return stored_map(slot_stats(df.withColumn(slot, slot_of(keys, n_slots)), slot, size), n_shards, path)


def place(df: DataFrame, keys: list[Column], slot_map: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """Records with ``virtual_slot`` and ``shard``; the map has at most ``n_slots`` rows, so it is broadcast."""
    (slot,) = temp_name(df, "slot")
    small = slot_map.select(F.col("slot").alias(slot), "shard")
    return df.drop("shard", "virtual_slot").withColumn(slot, slot_of(keys, n_slots)).join(F.broadcast(small), slot).withColumnRenamed(slot, "virtual_slot")


def with_copy(df: DataFrame, keys: list[Column], out: str = "copy", n_slots: int = N_SLOTS) -> DataFrame:
    """The caller's rows with ``out``: 0, or for rows whose keys are repeated a number from 1 to ``n_slots``.

    The numbers are fixed by a checkpoint, so give it the columns that are needed and no texts.
    """
    key, turn, copies = temp_name(df, "key", "turn", "copies")
    rows = cut(df.withColumns({key: F.xxhash64(*keys), turn: F.monotonically_increasing_id()}))
    repeated = rows.groupBy(key).agg(F.count(F.lit(1)).alias(copies)).where(F.col(copies) > 1)
    # the rows of a hot key need not meet, so adaptive execution may split them
    dealt = F.sqrt(F.pmod(F.xxhash64(turn), F.lit(1 << 24)) / (1 << 24)) * n_slots  # so a number's share of the rows is in proportion to it
    return rows.join(repeated, key, "left").withColumn(out, F.when(F.col(copies).isNull(), F.lit(0)).otherwise(F.floor(dealt) + 1).cast("long")).drop(key, turn, copies)


def number(df: DataFrame, keys: list[Column], slot_map: DataFrame, order: list[Column], n_slots: int = N_SLOTS) -> DataFrame:
    """As place(), with ``slot``: the record's number in its shard, from 0 without gaps.

    A shard's records are its virtual slots one after the other; rows before a slot come from the map, so the only window
    over records is one per virtual slot.
    """
    vslot, base, rank = temp_name(df, "vslot", "base", "rank")
    before = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    small = slot_map.withColumn(base, F.coalesce(F.sum("rows").over(before), F.lit(0))).select(F.col("slot").alias(vslot), "shard", base)
    ranked = df.withColumn(vslot, slot_of(keys, n_slots)).drop("shard", "slot", "virtual_slot").withColumn(rank, F.row_number().over(Window.partitionBy(vslot).orderBy(*order)))
    return ranked.join(F.broadcast(small), vslot).withColumn("slot", (F.col(base) + F.col(rank) - 1).cast("long")).drop(base, rank).withColumnRenamed(vslot, "virtual_slot")
