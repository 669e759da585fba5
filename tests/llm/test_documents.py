"""SimHash, decontamination, mixing, sharding, toxicity and token counts against brute force, with the odd cases."""

import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import decontaminate, mixing, queries, sharding, simhash, tokens, toxicity
from quillon.llm.components import components

from . import helpers as h

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon " * 3
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "One", "b"), (5, "one two", "b"), (6, base, "c"), (7, base, "c"), (7, base, "c"), (8, base + "phi", None), (None, "one two", "a"), (9, "word " * 30_000, "a"), (10, "Größe ünïcode 中文 " * 5, "b")]
    return make(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_fingerprints_match_brute_force(odd):
    for r in odd.collect():
        got = simhash.fingerprint(r.text.encode() if r.text is not None else None)
        assert got % (1 << 64) == h.simhash(r.text)


@given(st.text(alphabet="ab CD\té \x0b", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint_of_any_text(text):
    assert simhash.fingerprint(text.encode()) % (1 << 64) == h.simhash(text)


@pytest.mark.parametrize("pair_limit", [32, 3])
def test_links_join_exactly_the_near_fingerprints(spark, pair_limit):
    """Clusters, chains and a crowd of neighbours, through both ways of joining a bucket."""
    rng = random.Random(5)
    prints = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            prints.add(x)
            for b in rng.sample(range(64), rng.randint(0, 3)):
                x ^= 1 << b
    prints = sorted(prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    fps = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r.node: r.root for r in components(simhash.links(fps, pair_limit)).collect()}
    want = h.components(signed, prints)
    mine = defaultdict(set)
    for x in signed:
        mine[got.get(x, x)].add(x)
    theirs = defaultdict(set)
    for x, c in zip(signed, want):
        theirs[c].add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_simhash_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    prints = [h.simhash(r.text) for r in docs]
    want = {(r.doc_id, f"{p:016x}", c) for r, p, c in zip(docs, prints, h.components([r.doc_id for r in docs], prints))}
    assert {tuple(r) for r in queries.op2_simhash(spark, sf_dir).collect()} == want


def test_keep_one(odd, empty):
    kept = simhash.keep_one(odd).collect()
    rows = odd.collect()
    want = h.components([r.doc_id for r in rows], [h.simhash(r.text) for r in rows])
    assert sorted(r.doc_id for r in kept) == sorted(set(want))
    assert {2, 3, 7, None}.isdisjoint(r.doc_id for r in kept)  # as 1 and 6 are, and as 5 is
    assert simhash.keep_one(empty).columns == empty.columns and simhash.keep_one(empty).count() == 0


def test_clashing_columns_are_kept(spark, odd):
    extra = odd.withColumns({c: F.lit(1) for c in ("__id", "__tie", "__none", "__row", "__slot", "__size", "__src", "size", "shard", "hits", "__rank", "__base", "__toxicity", "__hits")})
    assert simhash.keep_one(extra).columns == extra.columns
    assert set(extra.columns) <= set(sharding.place(extra, [F.col("doc_id")], sharding.build_map(extra, [F.col("doc_id")], F.lit(1), 3)).columns)
    assert mixing.mix(extra).count() == extra.count()
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert decontaminate.drop_contaminated(extra, bench).columns == extra.columns
    assert toxicity.drop_toxic(extra, spark.createDataFrame([], "doc_id long, toxic int")).columns == extra.columns


ITEMS = [(0, "the quick brown fox jumps over the lazy dog and then it runs far away from here"), (1, "short item"), (2, ""), (3, None), (4, "!!! ..."), (None, "nobody owns this"), (5, "the quick brown fox jumps over the lazy dog and then it runs")]


def test_contamination_against_brute_force(spark, empty):
    rng = random.Random(3)
    vocab = "the quick brown fox jumps over lazy dog and then it runs far away from here short item nobody owns this x y".split()
    texts = [None, "", "...", "short item", "SHORT item! short", ITEMS[0][1], ITEMS[0][1] + " x " + ITEMS[0][1], "y " * 5000 + ITEMS[5][1]]
    for _ in range(60):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 30))]
        if rng.random() < 0.6:
            src = ITEMS[rng.choice([0, 0, 5, 6])][1].split()
            a = rng.randrange(len(src))
            words[rng.randint(0, len(words)) : 0] = src[a : a + rng.randint(1, 16)]
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    for part_words in (decontaminate.PART_WORDS, 10):
        decontaminate.parts.__defaults__ = (part_words,)
        for r in decontaminate.scan(docs, bench).collect():
            n, hit, items = h.contamination(r.text, ITEMS)
            assert (r.hits.n_words, r.hits.n_hit, list(r.hits["items"])) == (n, hit, items), r.text
    decontaminate.parts.__defaults__ = (decontaminate.PART_WORDS,)
    assert decontaminate.scan(docs, bench.limit(0)).where("hits.n_hit > 0").count() == 0
    assert decontaminate.drop_contaminated(empty, bench).count() == 0


def test_remove_spans():
    text = "Keep this, then The QUICK brown (fox) and leave"
    assert decontaminate.remove_spans(text, [[3, 6]]) == "Keep this, then ) and leave"


def water(sizes, weights):
    caps = {s: 3.0 * n for s, n in sizes.items()}
    total, target, open_ = sum(sizes.values()), {}, dict(weights)
    while True:
        left = total - sum(target.values())
        over = [s for s in open_ if left * open_[s] / sum(open_.values()) > caps[s]]
        if not over:
            return target | {s: left * w / sum(open_.values()) for s, w in open_.items()}
        for s in over:
            target[s] = caps[s]
            del open_[s]


def test_mixing(spark, sf_dir, odd, empty):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for frame in (docs, odd):
        rows = mixing.mix(frame).collect()
        assert len(rows) == frame.count()
        sizes = defaultdict(int)
        for r in rows:
            assert r.size == len(h.WS.findall(r.text or ""))
            sizes[r.source] += r.size
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        want = water(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
        taken, biggest = Counter(), Counter()
        for r in rows:
            assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.copies <= 3
            taken[r.source] += r.copies * r.size
            biggest[r.source] = max(biggest[r.source], r.size)
        for s in sizes:
            assert abs(taken[s] - want[s]) <= 2 * biggest[s] + 1
        again = Counter((r.doc_id, r.size, r.copies) for r in mixing.mix(frame.repartition(7)).collect())
        assert again == Counter((r.doc_id, r.size, r.copies) for r in rows)
        assert mixing.emit(mixing.mix(frame)).count() == sum(r.copies for r in rows)
    assert mixing.mix(empty).count() == 0


def test_sharding(spark, sf_dir, odd, empty):
    rows = queries.op6_sharding(spark, sf_dir).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    load, slots = Counter(), defaultdict(list)
    for r in rows:
        assert r["size"] == len((docs[r.doc_id] or "").encode()) + 8 and r.text_crc32 == h.crc(docs[r.doc_id])
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert len(rows) == len(docs) and set(load) <= set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, top = sum(load.values()) / 24, max(r["size"] for r in rows)
    assert max(load.values()) <= mean + top
    keys = [F.col("doc_id"), sharding.text_crc(F.col("text"))]
    slot_map = sharding.build_map(odd, keys, sharding.record_bytes(F.col("text")), 4)
    assert sharding.number(odd, keys, slot_map, [F.col("doc_id")]).count() == odd.count()
    assert sharding.number(empty, keys, sharding.build_map(empty, keys, F.lit(1), 4), [F.col("doc_id")]).count() == 0


def test_rebalancing_moves_slots_only_where_needed(spark, tmp_path):
    stats = spark.createDataFrame([(i, 10 + i % 3, 1) for i in range(64)], "slot int, bytes long, rows long")
    v0 = sharding.first_map(stats, 4)
    v1 = sharding.rebalance(v0, 4)
    v2 = sharding.rebalance(v1, 5)
    path = str(tmp_path / "map")
    for v in (v0, v1, v2):
        sharding.save_map(v, path)
    assert sharding.load_map(spark, path).first().version == 2
    one, two = ({r.slot: r.shard for r in v.collect()} for v in (v1, v2))
    assert set(two.values()) == set(range(5)) and sum(one[s] != two[s] for s in one) <= 20


def test_toxicity(spark, odd, empty):
    rng = random.Random(2)
    words = [a + b for a in "ba ce di fo gu".split() for b in "ra ne li mo tu sa".split()]
    rows, labels = [], []
    for i in range(900):
        body = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randint(1, 3)):
                body.insert(rng.randrange(len(body)), rng.choice(["nastyword", "vile" + rng.choice(words)]))
        rows.append((i, " ".join(body), "s"))
        labels.append((i, int(toxic)))
    docs, marks = make(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    assert "nastyword" in model.voters and any(v.startswith("vile") for v in model.voters)
    scored = {r.doc_id: (r.score, r.out) for r in toxicity.score(docs.withColumn("out", toxicity.held_out(F.col("doc_id"))), model).collect()}
    assert all(out == (h.crc(str(i)) % 3 == 1) for i, (_, out) in scored.items())
    held = [(scored[i][0] >= 0.7, y) for i, y in labels if scored[i][1]]
    assert sum(a == bool(y) for a, y in held) / len(held) > 0.97
    low = toxicity.score(odd, model).where("score >= 0.7").count()
    assert low == 0
    nulls = spark.createDataFrame([(None, 1), (1, None), (5000, 1)], "doc_id long, toxic int")
    assert toxicity.fit(docs, nulls) is None and toxicity.score(odd, None).agg(F.max("score")).first()[0] == 0.0
    assert toxicity.drop_toxic(docs, marks).columns == docs.columns
    assert toxicity.score(empty, model).count() == 0


def test_token_counts_match_the_library(spark, sf_dir, odd, empty):
    sentencepiece = pytest.importorskip("sentencepiece")
    vocabularies = pytest.importorskip("public_tokenizers")
    path = vocabularies.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for frame in (docs, odd):
        for r in tokens.count_tokens(frame, path, chunk=500).collect():  # small chunks: most texts are cut
            assert r.n_tokens == len(sp.encode(r.text or "")), r.doc_id
    assert tokens.count_tokens(odd, path).count() == odd.count()
    assert tokens.count_tokens(empty, path).count() == 0


@given(st.text(max_size=80), st.integers(1, 9))
@settings(max_examples=150, deadline=None)
def test_any_text_in_any_chunks(text, k):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    machine = tokens.transducer(path)
    whole = tokens.SPACE + tokens.escape(text) if text else ""
    want = len(sentencepiece.SentencePieceProcessor(model_file=path).encode(text)) if text else 0
    assert machine.count(whole) == want
    if whole:
        assert machine.total([machine.chunk_map(whole[i : i + k]) for i in range(0, len(whole), k)]) == want
