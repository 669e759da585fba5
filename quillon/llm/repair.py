"""Least-cost repair of the structure of conversations, by depth-first branch-and-bound.

A conversation's rows, in the order of their turns, must become role initials of the form ``(s?(ua)+)?``. Rows may be kept
(0), given the role user or assistant (2) or deleted (3); an empty user or assistant row may be inserted anywhere (2).
Blank and duplicate rows must be deleted; a truncated row costs 1 unless it is deleted. Of the cheapest edit lists, the
one whose audit (the initials of its edits, in order) is least in ASCII is taken. An audit decides its cost and its result.

The search walks (row, state) nodes with an explicit stack, the child of the lowest bound first:

* suffix lower bounds come from one backward pass over a relaxed form, in which a conversation may end after its system row;
* the incumbent is the best complete (cost, audit); prefixes whose bound exceeds its cost are cut;
* a dominance table holds the best (cost, audit) that reached each node. A prefix that is no better is cut: at one node
  all prefixes have the same ways on, and no two audits of one cost are prefixes of each other. An empty stack proves
  that the incumbent is the best.

Audits are chains of letters that share their beginnings, so memory grows with the rows of one conversation, and two of
them are compared by jumping back to where they part.

Defined results: rows are ordered by turn (NULL first), role, text; NULL roles and texts read as one space; a row's first
fault counts (blank: nothing but ASCII white space; duplicate: role and text stood in an earlier row; truncated: the last
character that is no white space is not one of ``.!?``); roles of another initial, and empty ones, can't be kept; gaps are
the whole numbers missing between the least and the greatest turn; rows without conv_id are one conversation; one whose
rows are all absent gives zeros, an empty audit and no turns; an empty table gives no rows. A conversation is held by one
task, since its repair is one value.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after an initial, where it may follow.
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
WANTED = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
ROLES = {"u": "user", "a": "assistant"}
SPACE = " \t\n\x0b\x0c\r"


def faults(rows: list[tuple[str, str]]) -> list[str]:
    """The first fault of each (role, text), or ''."""
    seen, out = set(), []
    for row in rows:
        said = row[1].rstrip(SPACE)
        out.append("blank" if not said else "duplicate" if row in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add(row)
    return out


class Edit:
    """The last edit of a prefix, the edits before it, and a jump further back (of sizes that make ancestors quick to find)."""

    __slots__ = ("before", "letter", "length", "jump")

    def __init__(self, before: Edit | None = None, letter: str = ""):
        self.before, self.letter = before or self, letter
        self.length = before.length + 1 if before else 0
        far = before.jump if before else self
        self.jump = far.jump if before and before.length - far.length == far.length - far.jump.length else self.before


def audit_of(edit: Edit) -> str:
    letters = []
    while edit.length:
        letters.append(edit.letter)
        edit = edit.before
    return "".join(reversed(letters))


def earlier(a: Edit, b: Edit) -> bool:
    """Whether audit a is less than audit b, by the letters at which they part."""
    p, q = a, b
    while p.length != q.length:
        if p.length > q.length:
            p = p.jump if p.jump.length >= q.length else p.before
        else:
            q = q.jump if q.jump.length >= p.length else q.before
    if p is q:
        return a.length < b.length
    while p.before is not q.before:
        p, q = (p.jump, q.jump) if p.jump is not q.jump else (p.before, q.before)
    return p.letter < q.letter


#: What the relaxed form tells apart: nothing emitted yet, a user comes next, an assistant comes next.
RELAXED = {START: 0, SYSTEM: 1, ASSISTANT: 1, USER: 2}


def lower_bounds(initials: list[str], found: list[str]) -> list[tuple[int, int, int]]:
    """Least cost of the rows from each one on, for each relaxed state; a system row may be all there is."""
    bounds = [(0, 0, INSERT)]
    for initial, fault in zip(reversed(initials), reversed(found)):
        after, direct = bounds[-1], []
        for state in range(3):
            turned = 1 if state == 2 else 2
            best = DELETE + after[state]
            if fault not in ("blank", "duplicate"):
                own = TRUNCATED if fault else 0
                best = min(best, own + REROLE + after[turned])
                if initial == ("a" if state == 2 else "u"):
                    best = min(best, own + after[turned])
                elif initial == "s" and state == 0:
                    best = min(best, own + after[1])
            direct.append(best)
        start, user, assistant = direct
        bounds.append((min(start, INSERT + assistant, 2 * INSERT + user), min(user, INSERT + assistant), min(assistant, INSERT + user)))
    return bounds[::-1]


def search(initials: list[str], found: list[str]) -> tuple[int, str]:
    """(cost, audit) of the best edits."""
    n = len(initials)
    bounds = lower_bounds(initials, found)
    root = Edit()
    reached: dict[tuple[int, int], tuple[int, Edit]] = {(0, START): (0, root)}
    stack: list[tuple[int, int, int, Edit]] = [(0, START, 0, root)]
    incumbent: tuple[int, str] | None = None
    while stack:
        i, state, cost, last = stack.pop()
        if reached[i, state][1] is not last or (incumbent and cost + bounds[i][RELAXED[state]] > incumbent[0]):
            continue
        if i == n and state in (START, ASSISTANT):
            leaf = (cost, audit_of(last))
            incumbent = leaf if incumbent is None else min(incumbent, leaf)
        wanted = WANTED[state]
        ways = [("I", i, NEXT[state, wanted], INSERT)]
        if i < n:
            ways.append(("D", i + 1, state, DELETE))
            if found[i] not in ("blank", "duplicate"):
                own = TRUNCATED if found[i] else 0
                ways.append(("R", i + 1, NEXT[state, wanted], own + REROLE))
                if (state, initials[i]) in NEXT:
                    ways.append(("K", i + 1, NEXT[state, initials[i]], own))
        children = []
        for letter, j, to, price in ways:
            total, edit = cost + price, Edit(last, letter)
            bound = total + bounds[j][RELAXED[to]]
            if incumbent and bound > incumbent[0]:
                continue
            known = reached.get((j, to))
            if known is None or total < known[0] or (total == known[0] and earlier(edit, known[1])):
                reached[j, to] = (total, edit)
                children.append((bound, letter, (j, to, total, edit)))
        stack.extend(node for _, _, node in sorted(children, key=lambda c: c[:2], reverse=True))
    assert incumbent is not None  # all rows deleted is always a way
    return incumbent


def apply(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The rows that an audit leaves."""
    out, state, source = [], START, iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(source)
        if letter == "D":
            continue
        initial = role[:1] if letter == "K" else WANTED[state]
        out.append((role if letter == "K" else ROLES[initial], text))
        state = NEXT[state, initial]
    return out


RESULT = "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role:string,text:string>>"


def _mend(conv_id: str | None, turns: list[int | None], rows: list[tuple[str, str]]) -> dict:
    found, initials = faults(rows), [role[:1] for role, _ in rows]
    cost, audit = search(initials, found)
    known = {t for t in turns if t is not None}
    counts = {fault: found.count(fault) for fault in ("blank", "duplicate", "truncated")}
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    repaired = [{"role": r, "text": t} for r, t in apply(rows, audit)]
    return {"conv_id": conv_id, "gaps": max(known) - min(known) + 1 - len(known) if known else 0, **counts, "illegal": illegal, "cost": cost, "audit": audit, "repaired": repaired}


def _mend_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order; a conversation ends where the next one begins."""
    turn = pa.struct([("role", pa.string()), ("text", pa.string())])
    schema = pa.schema([("conv_id", pa.string()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired", pa.list_(turn))])
    current: list[str | None] = []
    turns, held, done = [], [], []
    for batch in batches:
        for key, t, role, text, here in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "present"))):
            if current != [key]:
                if current:
                    done.append(_mend(current[0], turns, held))
                current, turns, held = [key], [], []
            if here:
                turns.append(t)
                held.append((role, text))
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
            done = []
    if current:
        yield pa.RecordBatch.from_pylist([_mend(current[0], turns, held)], schema)


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired) of every conversation.

    Rows where ``present`` is not true only name their conversation.
    """
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))]
    here = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    read = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), *said, here.alias("present"))
    ordered = read.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text")
    mended = ordered.withColumn("conv_id", F.col("conv_id").cast("string")).mapInArrow(_mend_all, RESULT)
    return mended.withColumn("conv_id", F.col("conv_id").cast(read.schema["conv_id"].dataType))
