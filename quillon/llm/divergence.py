"""How the sources of a language differ in their terms: a divergence of every pair of sources, and each source's own terms.

Chunk factorization: texts are cut at ASCII white space, which no term crosses. Tasks count the chunks of each document
and pre-aggregate them per (language, source): occurrences, documents, and the first and last of these. Each globally
distinct chunk is tokenized once, on the first of its rows, and its terms are joined back to the other rows of the same
key. Documents of a term are told apart by number only where no chunk of the term has ``MIN_DOCS`` of them; a chunk with
fewer is known by its first and last document, so the count of distinct documents is exact.

A language keeps the V terms in at least ``MIN_DOCS`` of its documents. A group is a (language, source), or a language.
With N the occurrences of kept terms in a group, a term of count c has p = 1 + floor(10^9 (c + 1) / (N + V)) there; two
groups differ at a term by floor((p - q)^2 / q). Pairs of sources are summed block by block: a block holds some
``BLOCK_TERMS`` terms of a language with their counts in every source, so no pairs of rows are joined or shuffled, only
one partial sum per block and pair. All arithmetic is in whole numbers (N + V below 9 * 10^15).

Defined results: NULL text, language or source reads as ''; a document is a row, and equal rows are documents each; empty
texts count as documents without terms; a source without terms, and a language that keeps none, take part with value 0;
ties of a rank go to the item first in UTF-8; an empty table gives no rows; other columns are not looked at. The rows
must come from a table (or another source that numbers them alike when it is read again).

A task holds about ``HELD`` chunk counts and one batch of texts; the matrix of a block has one column per source of a language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

MIN_DOCS = 3
TOP_TERMS = 200
SCALE_STEPS, SCALE_STEP = 3, 1000  # 10^9, in steps that keep long division within 64 bits
BLOCK_TERMS = 8192
HELD = 1_000_000
PART = 200_000
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DOCS = "n long, docs long, first_doc long, last_doc long"
CHUNKS, TERMS = f"lang string, source string, chunk string, {DOCS}", f"lang string, source string, term string, {DOCS}"


def terms(text: Column) -> Column:
    """The terms of a text, in order, with repeats."""
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(TERM), F.lit(0))


def _codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = values.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _summed(name: str, rows: pa.Table) -> pa.RecordBatch:
    """Rows summed by (lang, source, name), with up to ``MIN_DOCS`` documents told apart.

    Documents are kept only where they are all: a first one, and a last one if it is another.
    """
    keys = [_codes(rows.column(c).combine_chunks()) for c in ("lang", "source", name)]
    key = (keys[0][0] * len(keys[1][1]) + keys[1][0]) * len(keys[2][1]) + keys[2][0]
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    at = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(key)]))
    n, docs = (rows.column(c).to_numpy()[order] for c in ("n", "docs"))
    first = rows.column("first_doc").fill_null(-1).to_numpy()[order]
    last = np.maximum(first, rows.column("last_doc").fill_null(-1).to_numpy()[order])
    least, most = np.minimum.reduceat(first, start), np.maximum.reduceat(last, start)
    between = np.logical_or.reduceat(((first > least[at]) & (first < most[at])) | ((last > least[at]) & (last < most[at])), start)
    known = np.maximum(np.maximum.reduceat(docs, start), np.where(between, MIN_DOCS, np.where(least < most, 2, 1)))
    few = known < MIN_DOCS
    names = [pa.DictionaryArray.from_arrays(pa.array(k[order][start]), values).cast(pa.string()) for k, values in keys]
    return pa.RecordBatch.from_arrays([*names, pa.array(np.add.reduceat(n, start)), pa.array(known), pa.array(least, mask=~few), pa.array(most, mask=~few | (known == 1))], names=["lang", "source", name, "n", "docs", "first_doc", "last_doc"])


def _count_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        texts, ids = batch.column("text").cast(pa.binary()), batch.column("doc").to_numpy()
        i = 0
        while i < len(texts):
            chunks, counts, sizes, begin = [], [], [], i
            while i < len(texts) and len(chunks) < PART:
                found = Counter(texts[i].as_py().split())  # bytes split at ASCII white space
                chunks.extend(found)
                counts.extend(found.values())
                sizes.append(len(found))
                i += 1
            doc = pa.array(np.repeat(np.arange(begin, i), sizes))
            own, row = batch.select(["lang", "source"]).take(doc), pa.array(np.repeat(ids[begin:i], sizes))
            ones = pa.array(np.ones(len(chunks), np.int64))
            held.append(pa.table({"lang": own.column("lang"), "source": own.column("source"), "chunk": pa.array(chunks, pa.binary()).cast(pa.string()), "n": pa.array(counts, pa.int64()), "docs": ones, "first_doc": row, "last_doc": row}))
            size += len(chunks)
            if size >= HELD:
                yield _summed("chunk", pa.concat_tables(held))
                held, size = [], 0
    if size:
        yield _summed("chunk", pa.concat_tables(held))


def chunk_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, chunk, n, docs, first_doc, last_doc) of every distinct chunk of a source, partitioned by chunk.

    The two documents are NULL from ``MIN_DOCS`` documents on; with one document the last is NULL. Texts are dealt out by
    ranges of (language, source, document): large sources fall into several ranges, and the documents of a source share
    many chunks, so that what is counted together is smaller than the texts.
    """
    numbered = docs.select("lang", "source", "text", F.monotonically_increasing_id().alias("doc"))
    parts = numbered.repartitionByRange("lang", "source", "doc").mapInArrow(_count_chunks, CHUNKS).repartition("chunk")
    seen = parts.groupBy("chunk", "lang", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.min("first_doc").alias("a"), F.max(F.coalesce("last_doc", "first_doc")).alias("b"))
    few = F.col("docs") < MIN_DOCS
    return seen.select("lang", "source", "chunk", "n", "docs", F.when(few, F.col("a")).alias("first_doc"), F.when(few & (F.col("docs") > 1), F.col("b")).alias("last_doc"))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        size += batch.num_rows
        if size >= HELD:
            yield _summed("term", pa.concat_tables(held))
            held, size = [], 0
    if size:
        yield _summed("term", pa.concat_tables(held))


def term_counts(chunks: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) from the chunks, partitioned by (lang, term); docs is exact below ``MIN_DOCS`` and not below it otherwise."""
    same = Window.partitionBy("chunk").orderBy("lang", "source")
    numbered = chunks.withColumn("at", F.row_number().over(same))
    once = numbered.withColumn("terms", F.first(F.when(F.col("at") == 1, terms(F.col("chunk")))).over(same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    spread = once.select("lang", "source", F.explode("terms").alias("term"), "n", "docs", "first_doc", "last_doc")
    parts = spread.mapInArrow(_count_terms, TERMS).repartition("lang", "term")
    # one row for each document that is told apart; the first has the occurrences
    doc = F.explode(F.when(F.col("last_doc").isNull(), F.array("first_doc")).otherwise(F.array("first_doc", "last_doc")))
    rows = parts.select("lang", "source", "term", "n", "docs", "first_doc", doc.alias("doc"))
    own = rows.withColumn("n", F.when(F.col("doc").eqNullSafe(F.col("first_doc")), F.col("n")).otherwise(0))
    by_doc = own.groupBy("lang", "term", "source", "doc").agg(F.sum("n").alias("n"), F.max("docs").alias("docs"))
    return by_doc.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.greatest(F.count("doc"), F.max("docs")).alias("docs"))


def kept_terms(counted: DataFrame) -> DataFrame:
    """(lang, source, term, n) of the terms in enough documents of their language; documents of two sources differ."""
    return counted.withColumn("all_docs", F.sum("docs").over(Window.partitionBy("lang", "term"))).where(F.col("all_docs") >= MIN_DOCS).drop("docs", "all_docs")


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (count + 1) / total), by long division."""
    whole, rest = np.divmod(count + 1, total)
    for _ in range(SCALE_STEPS):
        digit, rest = np.divmod(rest * SCALE_STEP, total)
        whole = whole * SCALE_STEP + digit
    return 1 + whole


RESULT = "lang string, source string, part string, item string, value long"


def _compare(rows: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Sums over the pairs of sources, and the best terms of each source, in one block of a language."""
    if not len(groups):
        return pd.DataFrame({c.split()[0]: [] for c in RESULT.split(", ")})
    groups = groups.sort_values("source", ignore_index=True)
    names = groups["source"].to_numpy()
    at_source = {s: i for i, s in enumerate(names)}
    term, words = pd.factorize(rows["term"])
    count = np.zeros((len(names), len(words)), np.int64)
    count[rows["source"].map(at_source).to_numpy(np.int64), term] = rows["n"]
    total = (groups["size"] + groups["kept"]).to_numpy(np.int64)
    everywhere = np.int64(groups["size"].sum() + groups["kept"].iloc[0])
    out = []
    if len(words):
        p = shares(count, total[:, None])
        q = shares(count.sum(axis=0), everywhere)
        own = np.where((count > 0) & (p > q), (p - q) ** 2 // q, -1)
    lang = groups["lang"].iloc[0]
    for i, source in enumerate(names):
        sums = ((p[i] - p) ** 2 // p).sum(axis=1) if len(words) else np.zeros(len(names), np.int64)
        others = np.arange(len(names)) != i
        out.append(pd.DataFrame({"lang": lang, "source": source, "part": "pair", "item": names[others], "value": sums[others]}))
        if len(words):
            best = np.flatnonzero(own[i] >= 0)
            if len(best) > TOP_TERMS:
                last = np.partition(own[i][best], len(best) - TOP_TERMS)[len(best) - TOP_TERMS]
                best = best[own[i][best] >= last]
            out.append(pd.DataFrame({"lang": lang, "source": source, "part": "term", "item": words[best], "value": own[i][best]}))
    return pd.concat(out)


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has every other source of the language, part `term` a source's own terms.

    ``docs`` has text, lang and source.
    """
    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept, _ = stored(kept_terms(term_counts(chunk_counts(read))), "terms")
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    vocabulary = kept.groupBy("lang", "term").agg(F.lit(1).alias("one")).groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    named = read.groupBy("lang", "source").agg(F.lit(1).alias("one")).drop("one")
    groups = named.join(sizes, ["lang", "source"], "left").join(vocabulary, "lang", "left").na.fill(0, ["size", "kept"])
    groups, _ = stored(groups, "groups")
    # one number: the blocks of the language that keeps most terms
    blocks = -(-int(groups.agg(F.max("kept")).first()[0] or 0) // BLOCK_TERMS) or 1
    rows = kept.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int"))
    to_blocks = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    parts = rows.groupBy("lang", "block").cogroup(to_blocks.groupBy("lang", "block")).applyInPandas(_compare, RESULT)
    summed = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = summed.where("part = 'pair'").withColumn("rank", F.row_number().over(order))
    best = summed.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP_TERMS)
    return ranked.unionByName(best)
