"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all test items are put into one suffix automaton. Documents are streamed through it word by word;
the automaton keeps the length of the longest match that ends at each word. Where that length reaches the window, the
last ``window`` words stand in a test item and are hit; items shorter than the window count where they occur whole. Spans
of hit words can be removed, and documents are contaminated if the hit share reaches the coverage limit.

Items of equal words are one entry with several ids. Entries are put into parts of at most ``PART_WORDS`` words by tasks,
which write one automaton for each into the shared folder; longer items are cut into pieces that overlap by a window less a
word, so that every window stays in one piece. Parts go over the documents one after the other, and the broadcast of one is
dropped before the next is loaded: the driver and a worker hold one automaton at a time however many items there are. With
several parts the documents are written to the shared folder once, with a number each; every part adds only the numbers,
items and spans of the rows it hits, and these are merged and joined back at the end. One part needs no writing.

Defined results: a NULL or empty text has no words, no hits and is clean; an item without words never occurs; a NULL
item id is never reported, but its words count as hits; equal items all count; an empty benchmark leaves every document
clean; equal documents are judged alike; columns of the caller are kept, and the working columns avoid their names.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_path, remove, stored, temp_name

WINDOW = 13
COVERAGE = 20  # contaminated from one hit word in so many
PART_WORDS = 150_000

#: Words in UTF-8, after lower-casing A-Z: digits, a-z and everything beyond ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: The same in characters: after lower-casing, and in any case.
WORDS, ANY_CASE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: bytes | None) -> list[bytes]:
    return _WORD.findall((text or b"").lower())


class Automaton:
    """Suffix automaton of several word sequences.

    ``step`` maps state * V + word to a state; ``link`` and ``size`` are the usual suffix links and longest lengths.
    ``owners`` has, for each state whose strings include one of exactly ``window`` words, the entries that contain it;
    ``whole`` has for each state the (length, entry) of the short entries that are suffixes of its strings, one of a length
    at most. An entry is what items of equal words share; ``ids`` has their ids.
    """

    def __init__(self, items: list[tuple[list[str], list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids: list[list[str]] = []
        equal: dict[tuple, int] = {}
        for names, seq in items:
            entry = equal.setdefault(tuple(seq), len(self.ids))
            if entry == len(self.ids):
                self.ids.append([])
            self.ids[entry] += names
        self.vocab: dict[bytes, int] = {}
        self.step: dict[int, int] = {}
        self.link, self.size = [-1], [0]
        out: list[dict[int, int]] = [{}]
        owners: list[set] = [set()]
        ends: list[list] = [[]]
        for seq, item in equal.items():
            last, at = 0, []
            for w in seq:
                last = self._extend(out, owners, ends, last, self.vocab.setdefault(w, len(self.vocab)))
                at.append(last)
            if len(seq) >= window:
                for s in at:
                    while s > 0 and item not in owners[s]:
                        owners[s].add(item)
                        s = self.link[s]
            elif seq:
                ends[at[-1]].append((len(seq), item))
        v = max(1, len(self.vocab))
        self.step = {s * v + c: t for s, row in enumerate(out) for c, t in row.items()}
        order = sorted(range(1, len(self.size)), key=self.size.__getitem__)
        self.whole: dict[int, tuple] = {}
        for s in order:  # shorter strings first: a state takes over what its suffixes have
            if got := (*ends[s], *self.whole.get(self.link[s], ())):
                self.whole[s] = got
        self.owners = {s: frozenset(owners[s]) for s in order if self.size[s] >= window > self.size[self.link[s]] and owners[s]}

    def _extend(self, out: list, owners: list, ends: list, last: int, c: int) -> int:
        link, size = self.link, self.size
        if c in out[last]:
            q = out[last][c]
            return q if size[q] == size[last] + 1 else self._split(out, owners, ends, last, c, q)
        cur = len(size)
        size.append(size[last] + 1)
        link.append(0)
        out.append({})
        owners.append(set())
        ends.append([])
        p = last
        while p != -1 and c not in out[p]:
            out[p][c] = cur
            p = link[p]
        if p != -1:
            q = out[p][c]
            link[cur] = q if size[q] == size[p] + 1 else self._split(out, owners, ends, p, c, q)
        return cur

    def _split(self, out: list, owners: list, ends: list, p: int, c: int, q: int) -> int:
        link, size = self.link, self.size
        new = len(size)
        size.append(size[p] + 1)
        link.append(link[q])
        out.append(dict(out[q]))
        owners.append(set(owners[q]))
        ends.append([])
        link[q] = new
        while p != -1 and out[p].get(c) == q:
            out[p][c] = new
            p = link[p]
        return new

    def scan(self, seq: list[bytes]) -> tuple[list[list[int]], set]:
        """Hit spans [first, last] of a word sequence, disjoint and in order, and the items that occur."""
        step, link, size, whole, owners = self.step, self.link, self.size, self.whole, self.owners
        v, window, get = max(1, len(self.vocab)), self.window, self.vocab.get
        spans: list[list[int]] = []
        met, entries = set(), set()  # states of windows, and short entries; their ids are looked up once
        state = length = 0
        for i, w in enumerate(seq):
            c = get(w)
            if c is None:
                state = length = 0
                continue
            to = step.get(state * v + c)
            while to is None and state:
                state = link[state]
                length = size[state]
                to = step.get(state * v + c)
            if to is None:
                continue
            state = to
            length += 1
            first = i + 1
            if length >= window:
                first = i - window + 1
                s = state
                while size[link[s]] >= window:
                    s = link[s]
                met.add(s)
            if state in whole:
                for n, item in whole[state]:
                    if n <= length:
                        entries.add(item)
                        first = min(first, i - n + 1)
            if first <= i:
                while spans and spans[-1][0] >= first:
                    spans.pop()
                if spans and spans[-1][1] >= first - 1:
                    spans[-1][1] = i
                else:
                    spans.append([first, i])
        for s in met:
            entries |= owners[s]
        return spans, {x for e in entries for x in self.ids[e]}


def merge(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def pieces(seq: list[bytes], most: int, window: int) -> Iterator[list[bytes]]:
    """A long item in pieces that hold all its windows."""
    most = max(most, window)
    if len(seq) <= most:
        yield seq
        return
    for a in range(0, len(seq) - window + 1, most - window + 1):
        yield seq[a : a + most]


def parts(benchmark: DataFrame, item_id: str, text: str, part_words: int = PART_WORDS, *, window: int = WINDOW) -> tuple[str, list[str]]:
    """The folder, and files of one automaton each, of parts of bounded size; tasks build them."""
    spark = benchmark.sparkSession

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n = [], 0
        for batch in batches:
            for names, body in zip(batch["names"], batch["body"]):
                for seq in pieces(words(body), part_words, window):
                    if part and n + len(seq) > part_words:
                        yield pd.DataFrame({"automaton": [pickle.dumps(Automaton(part, window))]})
                        part, n = [], 0
                    if seq:
                        part.append((list(names), seq))
                        n += len(seq)
        if part:
            yield pd.DataFrame({"automaton": [pickle.dumps(Automaton(part, window))]})

    said = F.array_join(F.regexp_extract_all(F.translate(F.col(text), _UPPER, _UPPER.lower()), F.lit(WORDS), F.lit(0)), " ")
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), said.alias("said")).where("said != ''")
    entries = items.groupBy("said").agg(F.collect_list("item").alias("names")).select("names", F.col("said").cast("binary").alias("body"))
    size = entries.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    path = fresh_path(spark, "automata")
    # few parts, as each is a pass over the documents: tasks get some parts' worth of bytes rather than less than one
    entries.repartition(max(1, size // (8 * part_words))).mapInPandas(build, "automaton binary").write.option("maxRecordsPerFile", 1).parquet(path)
    return path, sorted(spark.read.schema("automaton binary").parquet(path).inputFiles())


def _loaded(spark: SparkSession, file: str) -> Automaton | None:
    row = spark.read.schema("automaton binary").parquet(file).first()
    return pickle.loads(row[0]) if row else None


KIND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())))])


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, out: str = "hits") -> DataFrame:
    """The caller's columns, with ``out``: (n_words, n_hit, items, spans); spans count words from 0, both ends included."""
    spark: SparkSession = docs.sparkSession
    folder, files = parts(benchmark, item_id, item_text, window=window)
    if len(files) <= 1:
        held = spark.sparkContext.broadcast((_loaded(spark, files[0]) if files else None) or Automaton([], window))
        remove(spark, folder)
        return docs.withColumn(out, _scanner(held)(F.col(text).cast("binary")))
    number, found, listed = temp_name(docs, "number", "found", "listed")
    kept, _ = stored(docs.withColumn(number, F.monotonically_increasing_id()), "documents")
    path = fresh_path(spark, "hits")
    for file in files:
        if automaton := _loaded(spark, file):
            held = spark.sparkContext.broadcast(automaton)
            # not deterministic, so that the filter is not pushed below it and the scan runs once
            rows = kept.select(number, _scanner(held).asNondeterministic()(F.col(text).cast("binary")).alias(found)).where(F.col(f"{found}.n_hit") > 0)
            rows.select(number, f"{found}.items", f"{found}.spans").write.mode("append").parquet(path)
            held.unpersist()
    remove(spark, folder)
    every = spark.read.schema(f"`{number}` long, items array<string>, spans array<array<bigint>>").parquet(path)
    # at most one row of a document and part
    by_row = every.groupBy(number).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias(listed), F.flatten(F.collect_list("spans")).alias("spans"))
    merged = by_row.select(number, listed, _merged("spans").alias(found))
    n_hit = F.aggregate(found, F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0] + 1)
    row = F.struct(
        F.coalesce(F.regexp_count(F.col(text), F.lit(ANY_CASE)), F.lit(0)).cast("long").alias("n_words"),
        F.coalesce(n_hit, F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(listed, F.array().cast("array<string>")).alias("items"),
        F.coalesce(found, F.array().cast("array<array<bigint>>")).alias("spans"),
    )
    return kept.join(merged, number, "left").withColumn(out, row).select(*docs.columns, out)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.LongType())))
def _merged(spans: pd.Series) -> pd.Series:
    return pd.Series([merge([list(x) for x in s]) for s in spans], dtype=object)


def _scanner(held):
    def run(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in columns:
            rows = []
            for body in texts:
                seq = words(body)
                spans, found = held.value.scan(seq)
                rows.append((len(seq), sum(b - a + 1 for a, b in spans), sorted(found), spans))
            yield pd.DataFrame(rows, columns=KIND.names)

    return F.pandas_udf(run, KIND)


def contaminated(hits: str = "hits", coverage: int = COVERAGE):
    return (F.col(f"{hits}.n_hit") > 0) & (F.col(f"{hits}.n_hit") * coverage >= F.col(f"{hits}.n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents below the coverage limit, with the caller's columns."""
    (mark,) = temp_name(docs, "hits")
    return scan(docs, benchmark, out=mark, **options).where(~contaminated(mark)).drop(mark)


def remove_spans(text: str, spans: list[list[int]]) -> str:
    """The text without the words of ``spans`` and what stands between them; the rest is untouched."""
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw.lower())]
    keep, last = [], 0
    for a, b in spans:
        keep.append(raw[last : at[a][0]])
        last = at[b][1]
    return b"".join([*keep, raw[last:]]).decode()


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
