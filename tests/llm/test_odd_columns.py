"""Ids of other types, clashing columns, long lines, folders by brute force."""

import posixpath

from pyspark.sql import functions as F

from quillon.llm import decontaminate, licenses, queries, simhash, tokens

from . import helpers as h


def test_near_duplicates_with_string_ids(spark):
    rows = [("b", "one two three four"), ("a", "one two three four"), ("c", "something else here"), (None, "one two three four"), ("c", "something else here"), ("0", None), ("z", "")]
    frame = spark.createDataFrame(rows, "doc_id string, text string").withColumns({"fp": F.lit(1), "id": F.lit(2), "root": F.lit(3)})
    kept = simhash.keep_one(frame)
    assert sorted((r.doc_id, r.fp, r.id, r.root) for r in kept.collect()) == [("0", 1, 2, 3), ("a", 1, 2, 3), ("c", 1, 2, 3)] and kept.columns == frame.columns
    ids = {(r.id, r.component_id) for r in simhash.component_ids(frame).collect()}
    assert ids == {("a", "a"), ("b", "a"), (None, "a"), ("c", "c"), ("0", "0"), ("z", "0")}


def test_token_counts_beside_clashing_columns(spark):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(1, "hello world " * 300), (1, "hello world " * 300), (2, None), (3, "x"), (4, "hello world " * 299 + "hello_world ")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"h": F.lit("mine"), "__h": F.lit("mine"), "n_tokens": F.lit(-1), "size": F.lit(0)})
    got = tokens.count_tokens(frame, path, chunk=64).collect()
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted((i, len(sp.encode(t or ""))) for i, t in rows)
    assert all(r.h == r["__h"] == "mine" for r in got)


def test_license_columns_that_clash_and_long_lines(spark):
    notice = "Copyright 2020 Jane Doe. Released under the MIT License. See the file for details about how to use this project."
    long = "plain words go on " * 20_000
    rows = [(1, "a/x", notice), (2, "b/y", long + notice + " " + long), (3, "b/z", long)]
    frame = spark.createDataFrame(rows, "n int, path string, text string").withColumns({c: F.lit("mine") for c in ("license", "score", "line", "effective", "folder", "hit", "up", "depth", "declared")})
    got = licenses.scan_licenses(frame, "text", "path")
    assert {r.n: r.license for r in got.collect()} == {1: "MIT", 2: "MIT", 3: None}
    assert got.where("folder = 'mine' and hit = 'mine' and up = 'mine' and depth = 'mine' and declared = 'mine'").count() == 3


def test_license_query_against_folders_by_hand(spark, sf_dir):
    known = licenses.Templates()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    own, declared = {}, {}
    for r in docs:
        folder = f"{r.source or 'none'}/{r.doc_id // 4096}/{r.doc_id // 64}"
        name, score, line, share = known.scan(r.text)
        own[r.doc_id] = (folder, name, score)
        if name and share >= 0.5:
            declared[folder] = min(declared.get(folder, (0.0, "~")), (-score, name))
    for r in queries.op10_licenses(spark, sf_dir).collect():
        folder, name, score = own[r.doc_id]
        assert (r.license, round(r.score, 9)) == (name, round(score, 9))
        at = folder
        while at and at not in declared:
            at = posixpath.dirname(at)
        assert r.effective == (name or (declared[at][1] if at in declared else None))
        assert r.inherited_from == (at if not name and at in declared else None)


def test_contamination_keeps_clashing_columns(spark):
    item = " ".join(f"w{i}" for i in range(20))
    frame = spark.createDataFrame([(1, f"x {item} y", 5), (2, "clean", 6), (3, None, 7)], "doc_id long, text string, n_hit int").withColumn("items", F.lit("mine"))
    bench = spark.createDataFrame([(9, item), (9, item)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.scan(frame, bench).collect()}
    assert {i: (r.hits.n_words, r.hits.n_hit, r.hits["items"], r.n_hit, r["items"]) for i, r in got.items()} == {1: (22, 20, ["9"], 5, "mine"), 2: (1, 0, [], 6, "mine"), 3: (0, 0, [], 7, "mine")}
    assert h.contamination(f"x {item} y", [(9, item)]) == (22, 20, ["9"])
