"""SimHash near-duplicates, with pigeonring filtering.

Fingerprints are 64 majority votes over the hashes of a text's word shingles. Two fingerprints are linked if they differ
in at most ``MAX_BITS`` bits. The fingerprint is cut into a ring of ``SEGMENTS`` segments; by the pigeonring principle,
two fingerprints within the limit have a segment from which, going round, every chain of k segments differs in at most
k * MAX_BITS / SEGMENTS bits. With five segments and two bits that means: two consecutive segments are equal, the third
adds one bit at most, the fourth none beyond that, and the whole ring two. Equality of the first two is an equi-join
key; the longer chains prune the join's rows before the full Hamming distance.

Buckets of up to ``PAIR_LIMIT`` fingerprints are joined pair by pair. Larger ones take an exact way of linear size: two
fingerprints of a bucket differ in two bits or fewer exactly if they share a value that each reaches by changing one
bit or none, so fingerprints are linked to the smallest of those that share a value, and no group is expanded into pairs.

Defined results: a NULL or empty text, or one of white space, has fingerprint zero and is linked like any other; a text
of fewer words than a shingle is one shingle; equal rows share a group; a NULL doc_id never becomes the group's id unless
all ids are NULL; ids may be numbers or strings; an empty table gives no rows; columns of the caller are kept by
keep_one(), which keeps one of equal rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, temp_name
from .components import components

SHINGLE = 3
HASH_SEED = 42
MAX_BITS = 2
SEGMENTS = 5
PAIR_LIMIT = 32
BLOCK = 1 << 16

#: Segments as (first bit, width), once round the ring.
_CUTS = [round(64 * i / SEGMENTS) for i in range(SEGMENTS + 1)]
RING = [(_CUTS[i], _CUTS[i + 1] - _CUTS[i]) for i in range(SEGMENTS)]

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_OFFSETS = np.arange(8, dtype=np.int32) * 256


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text, as a signed 64-bit integer."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    starts = np.concatenate(([0], ends + 1))
    ends = np.concatenate((ends, [len(joined)]))
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n].tolist(), (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist()
    digest, votes = xxhash.xxh64_intdigest, np.zeros((8, 256), dtype=np.int64)
    for i in range(0, n, BLOCK):
        h = np.array([digest(joined[a:b], HASH_SEED) for a, b in zip(starts[i : i + BLOCK], ends[i : i + BLOCK])], dtype="<u8")
        cells = h.view(np.uint8).reshape(-1, 8) + _OFFSETS
        votes += np.bincount(cells.ravel(), minlength=2048).reshape(8, 256)
    bits = (votes @ _BITS) * 2 > n  # byte by bit, low bits first
    return int(np.packbits(bits.ravel(), bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([fingerprint(t) for t in batch], dtype="int64")


def fingerprint_column(text: Column) -> Column:
    return _fingerprints(text.cast("binary"))


def segment(fp: Column, i: int) -> Column:
    first, width = RING[i % SEGMENTS]
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))


def bucket_key(fp: Column, i: int) -> Column:
    """Segments i and i + 1 as one number."""
    return F.shiftleft(segment(fp, i), RING[(i + 1) % SEGMENTS][1]).bitwiseOR(segment(fp, i + 1))


def buckets(fps: DataFrame) -> DataFrame:
    """(fp, at, key): the bucket of each fingerprint for each start of a chain."""
    starts = F.array(*[F.struct(F.lit(i).alias("at"), bucket_key(F.col("fp"), i).alias("key")) for i in range(SEGMENTS)])
    return fps.select("fp", F.inline(starts))


def chain_fits(a: Column, b: Column, at: Column) -> Column:
    """Whether the chain from segment ``at`` stays within its budgets, up to the whole ring."""
    fits = F.lit(False)
    for i in range(SEGMENTS):
        total, ok = F.lit(0), F.lit(True)
        for k in range(1, SEGMENTS + 1):
            total = total + F.bit_count(segment(a.bitwiseXOR(b), i + k - 1))
            if k > 2:  # the first two are the join key
                ok = ok & (total <= k * MAX_BITS // SEGMENTS)
        fits = F.when(at == i, ok).otherwise(fits)
    return fits


def links(fps: DataFrame, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Links (u, v), u > v, that connect exactly the distinct fingerprints within MAX_BITS of each other."""
    keyed = buckets(fps)
    counts = keyed.groupBy("at", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cut(keyed.join(counts, ["at", "key"]))
    small, large = shared.where(F.col("n") <= pair_limit), shared.where(F.col("n") > pair_limit)
    a, b = small.select("at", "key", F.col("fp").alias("u")), small.select("at", "key", F.col("fp").alias("v"))
    pairs = a.join(b, ["at", "key"]).where((F.col("u") > F.col("v")) & chain_fits(F.col("u"), F.col("v"), F.col("at"))).select("u", "v")
    masks = []
    for i in range(SEGMENTS):
        fixed = {b for j in (i, i + 1) for b in range(RING[j % SEGMENTS][0], sum(RING[j % SEGMENTS]))}
        free = [b for b in range(64) if b not in fixed]
        masks.append(F.array(F.lit(0), *[F.lit(1 << b if b < 63 else -(1 << 63)) for b in free]))
    mask = masks[-1]
    for i in reversed(range(SEGMENTS - 1)):
        mask = F.when(F.col("at") == i, masks[i]).otherwise(mask)
    near = large.withColumn("mask", F.explode(mask)).select("at", "key", "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("value"))
    # at most 39 fingerprints are one bit or less from a value
    star = near.groupBy("at", "key", "value").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    stars = star.select(F.array_min("fps").alias("v"), F.explode("fps").alias("u")).where("u > v").select("u", "v")
    return pairs.union(stars).distinct()


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(id, tie, fp) of every row, computed once; ``tie`` is the text's hash."""
    return cut(docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("tie"), fingerprint_column(F.col(text)).alias("fp")))


def group_minimum(prints: DataFrame, value: Column) -> DataFrame:
    """(fp, root, least) of every distinct fingerprint: the smallest ``value`` among the rows of its group.

    Rows are brought down to their fingerprints before anything is shuffled by group, so large groups of copies are light.
    """
    own = prints.groupBy("fp").agg(F.min(value).alias("own"))
    roots = components(links(prints.select("fp").distinct())).select(F.col("node").alias("fp"), "root")
    own = own.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return own.join(own.groupBy("root").agg(F.min("own").alias("least")), "root").select("fp", "root", "least")


def component_ids(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(id, fp, component_id) of every row: the smallest id of the rows that links lead to."""
    prints = fingerprints(docs, text, doc_id)
    return prints.join(group_minimum(prints, F.col("id")), "fp").select("id", "fp", F.col("least").alias("component_id"))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The caller's rows without near-duplicates: the smallest id of each group stays. Ids may have any type with an order."""
    i, none, tie, row = temp_name(docs, "id", "none", "tie", "row")
    least = group_minimum(fingerprints(docs, text, doc_id), F.struct(F.col("id").isNull().alias("none"), "id", "tie"))
    as_text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    first = least.select("root", "least").distinct().select(as_text(F.col("least.id")).alias(i), F.col("least.none").alias(none), F.col("least.tie").alias(tie))
    tagged = docs.withColumns({i: as_text(F.col(doc_id)), none: F.col(doc_id).isNull(), tie: F.xxhash64(text)})
    kept = tagged.join(first, [i, none, tie], "left_semi")  # on the window's keys, so texts are shuffled once
    once = F.row_number().over(Window.partitionBy(i, none, tie).orderBy(F.lit(0)))
    return kept.withColumn(row, once).where(F.col(row) == 1).select(*docs.columns)
