"""Branch-and-bound against a layered shortest path; damaged conversations; odd rows."""

import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import queries, repair

from .helpers import sha

INSERTS = {q: [(q, 0, ""), (3 if q == 2 else 2, 2, "I")] + ([(3, 4, "II")] if q != 2 else []) for q in range(4)}
KEEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def shortest(initials, faults):
    """All states row by row, with their least (cost, audit)."""
    best = {0: (0, "")}
    for initial, fault in zip(initials, faults):
        new = {}
        for q, (cost, audit) in best.items():
            for z, price, letters in INSERTS[q]:
                ways = [("D", 3, z)]
                if fault not in ("blank", "duplicate"):
                    late = 1 if fault else 0
                    ways.append(("R", 2 + late, 3 if z == 2 else 2))
                    if (z, initial) in KEEPS:
                        ways.append(("K", late, KEEPS[z, initial]))
                for letter, own, to in ways:
                    found = (cost + price + own, audit + letters + letter)
                    new[to] = min(new.get(to, found), found)
        best = new
    return min((cost + price, audit + letters) for q, (cost, audit) in best.items() for z, price, letters in INSERTS[q] if z in (0, 3))


ROW = st.tuples(st.sampled_from("suat") | st.just(""), st.sampled_from(["", "", "", "blank", "duplicate", "truncated"]))


@settings(max_examples=400, deadline=None)
@given(st.lists(ROW, max_size=14))
def test_search_is_optimal(rows):
    initials, faults = [r[0] for r in rows], [r[1] for r in rows]
    assert repair.search(initials, faults) == shortest(initials, faults)


def test_long_conversations_take_linear_time():
    rng = random.Random(3)
    for letters in ("ua", "u", "a", "s", "suat"):
        initials = [rng.choice(letters) for _ in range(20_000)]
        faults = [rng.choice([""] * 6 + ["blank", "duplicate", "truncated"]) for _ in initials]
        start = time.time()
        found = repair.search(initials, faults)
        assert time.time() - start < 20
        assert found[0] == sum_of(found[1], faults)
    short = [rng.choice("suat") for _ in range(1500)]
    assert repair.search(short, [""] * 1500) == shortest(short, [""] * 1500)


def sum_of(audit, faults):
    rows = iter(faults)
    return sum(2 if e == "I" else {"K": 0, "R": 2, "D": 3}[e] + (next(rows) == "truncated" and e != "D") for e in audit)


def test_bounds_never_exceed_the_cost():
    rng = random.Random(9)
    for _ in range(300):
        initials = [rng.choice("suat") for _ in range(rng.randrange(9))]
        faults = [rng.choice(["", "", "blank", "truncated"]) for _ in initials]
        assert repair.lower_bounds(initials, faults)[0][0] <= shortest(initials, faults)[0]


def test_repairs_by_hand(spark):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "user", "Hello?"), (1, 3, "assistant", "Hi there"), (1, 4, "user", "More."), (1, 5, "user", "More."), (1, 6, "assistant", " \t"),
        (2, None, "tool", "x."), (2, None, None, None), (2, 7, "assistant", "Fine. \n"),
        (None, 0, "user", "a."), (None, 1, "assistant", "b."),
        (3, 0, "assistant", "Only me!"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("present", F.lit(True)).withColumns({n: F.lit(0) for n in ("copy", "audit", "cost")})
    gone = spark.createDataFrame([(4, 1, "user", "a", False)], "conv_id long, turn long, role string, text string, present boolean").withColumns({n: F.lit(0) for n in ("copy", "audit", "cost")})
    got = {r.conv_id: r for r in repair.repair(frame.unionByName(gone), present=F.col("present")).collect()}
    # blank and duplicate rows go, a missing answer comes in, the kept answer is truncated
    assert (got[1].gaps, got[1].blank, got[1].duplicate, got[1].truncated, got[1].illegal, got[1].cost, got[1].audit) == (1, 1, 1, 1, 1, 9, "KKKKDDI")
    assert [(t.role, t.text) for t in got[1].repaired] == [("system", "Be kind."), ("user", "Hello?"), ("assistant", "Hi there"), ("user", "More."), ("assistant", "")]
    # a row of spaces is blank; the other role is given anew
    assert (got[2].gaps, got[2].blank, got[2].cost, got[2].audit) == (0, 1, 5, "DRK")
    assert (got[None].cost, got[None].audit) == (0, "KK")
    assert (got[3].cost, got[3].audit) == (2, "IK") and [(t.role, t.text) for t in got[3].repaired] == [("user", ""), ("assistant", "Only me!")]
    assert (got[4].gaps, got[4].cost, got[4].audit, got[4].repaired) == (0, 0, "", [])
    assert repair.repair(frame.limit(0)).collect() == []


def test_large_ids_and_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        big = 2**60
        rows = [(big + i % 3, t, "user" if t % 2 == 0 else "assistant", f"said {t}.") for i in range(3) for t in range(20)] + [(None, 0, "user", "x.")]
        got = {r.conv_id: r for r in repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)).collect()}
        assert {k: r.audit for k, r in got.items()} == {big: "K" * 20, big + 1: "K" * 20, big + 2: "K" * 20, None: "DI"[:0] + "KI"}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_query_against_brute_force(spark, sf_dir):
    import zlib

    rows = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        rows.setdefault(r.conv_id, []).append(r)
    got = {r.conv_id: r for r in queries.op13_repair(spark, sf_dir).collect()}
    assert set(got) == set(rows)
    for conv, turns in rows.items():
        left = []
        for r in sorted(turns, key=lambda r: r.turn):
            kind = zlib.crc32(f"{conv}:{r.turn}".encode()) % 20
            role = "user" if kind == 4 else r.role
            text = "" if kind == 1 else r.text.translate({ord(c): None for c in ".!?"}) if kind == 2 else r.text
            left += [(r.turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
        faults = repair.faults([x[1:] for x in left])
        assert (got[conv].cost, got[conv].audit) == shortest([x[1][:1] for x in left], faults)
        lines, state = [], 0
        source = iter(left)
        for e in got[conv].audit:
            _, role, text = (0, "", "") if e == "I" else next(source)
            if e != "D":
                role = role if e == "K" else "assistant" if state == 2 else "user"
                lines.append(f"{role}:{text}")
                state = {"s": 1, "u": 2, "a": 3}[role[0]]
        assert got[conv].repaired_sha256 == sha("\n".join(lines))
