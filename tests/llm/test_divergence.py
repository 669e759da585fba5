"""Source divergence against a version with plain dictionaries."""

import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from quillon.llm import divergence, queries

from .helpers import lower

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows):
    counts, docs, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source, found = lang or "", source or "", TERM.findall(lower(text))
        langs[lang].add(source)
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, sources in langs.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= 3)

        def share(count):
            size = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (size + len(kept)) for t in kept}

        own = {s: share(counts[lang, s]) for s in sources}
        all_ = share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum((own[s][t] - own[o][t]) ** 2 // own[o][t] for t in kept)) for o in sources if o != s]
            terms = [(t, (own[s][t] - all_[t]) ** 2 // all_[t]) for t in kept if counts[lang, s][t] and own[s][t] > all_[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 200)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, n + 1) for n, (item, value) in enumerate(found[:most])]
    return sorted(out)


def rows_of(frame):
    return sorted(tuple(r) for r in frame.select("lang", "source", "part", "item", "value", "rank").collect())


def frame_of(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string").withColumns({n: F.lit(1) for n in ("term", "chunk", "n", "doc", "docs", "rank")})


def odd_rows():
    rng = np.random.default_rng(5)
    words = ["the", "The,", "THE.", "cat", "cat-dog", "dog;cat", "dog", "été", "Été", "naïve", "x1y", "12", "--", " the", "a b", "the\x1fcat", "日本", "日本。", "cat,dog,cat"]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 9))), ["en", "fr", None][i % 3], ["s1", "s2", "s3", None, ""][i % 5]) for i in range(90)]
    rows += [(None, "en", "s1"), ("", "de", "s9"), ("lonely words", "xx", "a"), ("lonely words", "xx", "a"), ("other", "xx", "b")]
    rows += [("rare-once more", "zz", "a"), ("rare.once", "zz", "b"), ("(rare) once?", "zz", "c"), ("rare rare,rare", "zz", "c")]
    return rows + [("same text again", "re", "q")] * 4 + [("the cat " * 30_000, "en", "long")]


def test_odd_rows_against_brute_force(spark):
    rows = odd_rows()
    assert rows_of(divergence.audit(frame_of(spark, rows).repartition(7))) == brute(rows)
    assert rows_of(divergence.audit(frame_of(spark, rows).limit(0))) == []


def test_small_tables_in_tasks_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 3)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 2)
    rows = odd_rows()
    assert rows_of(divergence.audit(frame_of(spark, rows).repartition(5))) == brute(rows)


def test_documents_of_rare_chunks_are_told_apart(spark):
    # "ab" stands in five chunks, no one in more than two documents: two documents in the first language, three in the second
    rows = [("ab, ab. ab;", "p", "s"), ("ab, ab! ab.", "p", "s"), ("ab, ab.", "q", "s"), ("ab! ab;", "q", "s"), ("ab?", "q", "s")]
    assert rows_of(divergence.audit(frame_of(spark, rows).repartition(3))) == brute(rows)
    kept = {r.lang: r.n for r in divergence.kept_terms(divergence.term_counts(divergence.chunk_counts(frame_of(spark, rows)))).collect()}
    assert kept == {"q": 5}


def test_shares_are_exact_beyond_64_bits():
    rng = np.random.default_rng(1)
    total = rng.integers(10**12, 9 * 10**15, 1000)
    count = (total * rng.random(1000)).astype(np.int64)
    assert divergence.shares(count, total).tolist() == [1 + 10**9 * (int(c) + 1) // int(t) for c, t in zip(count, total)]


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert rows_of(queries.op12_divergence(spark, sf_dir)) == brute(rows)
