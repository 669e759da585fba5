"""Long roles and texts, roles as they are, extra and clashing fields."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.llm import chat, queries

from .helpers import sha


def formatted(rows, spark):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_turns(chat.canonical_turns(chat.records_of_rows(table), ["messages"]))
    return {r.conv_id: r for r in out.select("conv_id", chat.read_turns(F.col("formatted")).alias("back"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}


@pytest.mark.parametrize("piece", ["a", "\\", "\n", "\\\n", "<|end|>\n", "é[INST]"])
def test_roles_and_texts_of_any_length(spark, piece):
    long = piece * (10_000_000 // len(piece) if piece == "a" else 300_000)
    got = formatted([(1, 0, long, "x"), (1, 1, "assistant", long), (2, 0, "user", "q")], spark)
    assert [(t.role, t.text) for t in got[1].back] == [(long, "x"), ("assistant", long)] and got[1].loss == long
    assert [(t.role, t.text) for t in got[2].back] == [("user", "q")]


def test_roles_round_trip(spark):
    rng = random.Random(3)
    rows = [(i, 0, "".join(rng.choice(["\\", "\n", "n", "\\n", "<", "|turn|>", "<|end|>\n", "/s>", "["]) for _ in range(rng.randint(0, 12))), "t") for i in range(800)]
    got = formatted(rows, spark)
    assert all(got[i].back[0].role == role for i, _, role, _ in rows)


def test_roles_of_rows_are_not_renamed(spark, tmp_path):
    rows = [(1, 0, "human", "q"), (1, 1, "gpt", "a"), (1, 2, "bot", "b"), (1, 3, "assistant", "c"), (2, 0, "model", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op7_chat(spark, str(tmp_path)).collect()}
    for c in (1, 2):
        mine = [(r, t or "") for i, _, r, t in rows if i == c]
        assert got[c].turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in mine))
        assert got[c].loss_sha256 == sha("".join(t for r, t in mine if r == "assistant"))


def test_extra_fields_and_records_without_a_layout(spark):
    messages = "array<struct<role:string,content:string,name:string,calls:array<string>>>"
    rows = [
        (0, [("user", "q", "n", ["c"]), ("assistant", "a", None, None)], None, None, None),
        (1, [("user", "q", None, None)], "s", None, None),
        (2, None, None, "p", None),
        (3, [("user", "q", None, None)], None, "p", "r"),
        (4, None, None, None, None),
        (5, [], None, None, None),
    ]
    frame = spark.createDataFrame(rows, f"n int, messages {messages}, system string, prompt string, response string").withColumn("layout", F.lit("mine")).withColumn("__turns", F.lit("kept"))
    done = chat.format_turns(chat.canonical_turns(frame, ["messages", "system", "prompt", "response"]))
    got = {r.n: (r.layout, [(t.role, t.text) for t in r.turns] if r.turns is not None else None, len(r.loss_spans), r["__turns"]) for r in done.collect()}
    assert got == {
        0: ("messages", [("user", "q"), ("assistant", "a")], 1, "kept"),
        1: ("system_messages", [("system", "s"), ("user", "q")], 0, "kept"),
        2: ("prompt", [("user", "p")], 0, "kept"),
        3: ("unmapped", [("prompt", "p"), ("response", "r"), ("messages:user", "q")], 0, "kept"),
        4: (None, None, 0, "kept"),
        5: ("messages", [], 0, "kept"),
    }
