"""Chat formatting by schema fingerprints.

Records come in many layouts: lists of messages, prompt and response, instruction with or without input. A record's
fingerprint is the hash of the nested field paths that it fills, of those that some mapping can use. The fingerprint
selects a declarative mapping, which says where the canonical turns (role, text) are; a template then writes the turns as
one text and marks what the loss covers. All of it is expressions on columns. Roles are kept as they are, but for the
"conversations" layout, whose own names (human, gpt, ...) are mapped to the canonical ones.

Control strings inside texts and roles are escaped: every backslash is doubled, then a backslash is put after the first
character of each control string. Taking every backslash away and keeping what follows it gives the text back. A line
feed in a role is a backslash and the letter n, so a turn's first line feed ends its role. No pattern repeats a group, so
roles and texts may have any length.

Defined results: a NULL text or role is an empty one; a record that fills usable fields but no known layout is kept whole
in the layout "unmapped", with a turn for each field (its role is the field's name) and each list element, which the loss
does not cover; one that fills no usable field has NULL layout and turns and an empty formatted text; rows of equal turn
numbers are ordered by role and text, NULL turns first; equal rows are turns of their own; rows without a conversation id
form one conversation; an empty table gives no rows. A conversation is one text in the result, so its rows meet in one
task. The caller's columns are kept, but those that have the name of an output (layout, turns, formatted, loss_spans) are
replaced by it.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import temp_name

TURN, END = "<|turn|>", "<|end|>\n"
#: Strings that mark structure in this template or in common ones.
CONTROL = r"(<)(\|turn\|>|\|end\|>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?<SYS>>|unk>|pad>)|(\[)(/?INST\])"
#: Roles of the "conversations" layout, and their canonical names.
ROLES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))


@dataclass(frozen=True)
class Layout:
    """Field paths of a layout, and where its turns are.

    ``parts`` are (role, paths): texts of one turn, joined by blank lines. ``each`` is (list, role field, text field), whose
    turns come after those of the parts; ``renamed`` are roles that get another name.
    """

    name: str
    paths: tuple[str, ...]
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    each: tuple[str, str, str] | None = None
    renamed: tuple[tuple[str, str], ...] = ()

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256("\n".join(sorted(self.paths)).encode()).hexdigest()


def _pair(name: str, question: tuple[str, ...], answer: str, system: str | None = None) -> Layout:
    first = ((("system", (system,)),) if system else ()) + (("user", question), ("assistant", (answer,)))
    return Layout(name, (*question, answer, *((system,) if system else ())), first)


_MESSAGES, _CONVERSATIONS, _SYSTEM = ("messages[].content", "messages[].role"), ("conversations[].from", "conversations[].value"), (("system", ("system",)),)
LAYOUTS = (
    Layout("messages", _MESSAGES, each=("messages", "role", "content")),
    Layout("system_messages", ("system", *_MESSAGES), _SYSTEM, ("messages", "role", "content")),
    Layout("conversations", _CONVERSATIONS, each=("conversations", "from", "value"), renamed=ROLES),
    Layout("system_conversations", ("system", *_CONVERSATIONS), _SYSTEM, ("conversations", "from", "value"), ROLES),
    Layout("prompt", ("prompt",), (("user", ("prompt",)),)),
    _pair("prompt_response", ("prompt",), "response"),
    _pair("prompt_completion", ("prompt",), "completion"),
    _pair("system_prompt_response", ("prompt",), "response", "system"),
    _pair("instruction_output", ("instruction",), "output"),
    _pair("instruction_input_output", ("instruction", "input"), "output"),
    _pair("question_answer", ("question",), "answer"),
)
UNMAPPED = "unmapped"

#: A schema that holds every layout, for records that arrive as JSON text.
RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("prompt", "response", "completion", "system", "instruction", "input", "output", "question", "answer")]
    + [T.StructField(n, T.ArrayType(T.StructType([T.StructField(a, T.StringType()), T.StructField(b, T.StringType())]))) for n, a, b in (("messages", "role", "content"), ("conversations", "from", "value"))]
)


def field_paths(df: DataFrame, fields: list[str], usable: frozenset[str] | None = None) -> Column:
    """The nested field paths that a row fills, sorted; a list that is not NULL fills the paths of its elements."""
    found: list[tuple[str, Column]] = []

    def walk(kind: T.DataType, path: str, filled: Column, at: Column | None) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                below = at[f.name] if at is not None else None
                walk(f.dataType, f"{path}.{f.name}", filled if below is None else filled & below.isNotNull(), below)
        elif isinstance(kind, T.ArrayType):
            walk(kind.elementType, f"{path}[]", filled, None)
        elif usable is None or path in usable:
            found.append((path, filled))

    for name in fields:
        walk(df.schema[name].dataType, name, F.col(name).isNotNull(), F.col(name))
    return F.array_compact(F.array(*[F.when(filled, F.lit(path)) for path, filled in sorted(found, key=lambda x: x[0])]).cast("array<string>"))


def fingerprint(df: DataFrame, fields: list[str], usable: frozenset[str] | None = None) -> Column:
    return F.sha2(F.concat_ws("\n", field_paths(df, fields, usable)), 256)


TURNS = "array<struct<role:string,text:string>>"


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _turns(layout: Layout) -> Column:
    first = F.array(*[_turn(F.lit(role), F.concat_ws("\n\n", *[F.col(p) for p in paths])) for role, paths in layout.parts]).cast(TURNS)
    if not layout.each:
        return first
    field, role, text = layout.each
    names = F.create_map(*[F.lit(x) for pair in layout.renamed for x in pair]) if layout.renamed else None
    listed = F.transform(F.col(field), lambda m: _turn(m[role] if names is None else F.coalesce(names[m[role]], m[role]), m[text]))
    return F.concat(first, listed) if layout.parts else listed


def _all_turns(layouts: list[Layout], fields: list[str]) -> Column:
    """A turn for each filled field and list element that the layouts can use, none of them in the loss."""
    lists = {x.each[0]: x.each for x in layouts if x.each}
    texts = [f for f in fields if f not in lists and any(f in x.paths for x in layouts)]
    turns = [F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), _turn(F.lit(f), F.col(f))) for f in texts]).cast(TURNS))]
    for field, role, text in lists.values():
        turns.append(F.coalesce(F.transform(F.col(field), lambda m: _turn(F.concat(F.lit(f"{field}:"), F.coalesce(m[role], F.lit(""))), m[text])), F.array().cast(TURNS)))
    return F.concat(*turns)


def canonical_turns(df: DataFrame, fields: list[str], layouts: tuple[Layout, ...] = LAYOUTS, out: str = "turns") -> DataFrame:
    """The caller's columns, with ``layout`` (name or NULL) and the canonical turns."""
    have = {f for f in fields}
    known = [x for x in layouts if {p.split("[")[0].split(".")[0] for p in x.paths} <= have]
    usable = frozenset(p for x in known for p in x.paths)
    if not known:
        return df.withColumns({"layout": F.lit(None).cast("string"), out: F.lit(None).cast(TURNS)})
    mark, lay, made = temp_name(df, "fingerprint", "layout", "turns")
    name = turns = None
    for x in known:
        hit = F.col(mark) == x.fingerprint
        name = F.when(hit, F.lit(x.name)) if name is None else name.when(hit, F.lit(x.name))
        turns = F.when(hit, _turns(x)) if turns is None else turns.when(hit, _turns(x))
    some = F.col(mark) != F.sha2(F.lit(""), 256)
    marked = df.withColumn(mark, fingerprint(df, fields, usable))
    marked = marked.withColumns({lay: name.when(some, F.lit(UNMAPPED)), made: turns.when(some, _all_turns(known, fields))})
    return marked.withColumns({"layout": F.col(lay), out: F.col(made)}).drop(mark, lay, made)


def parse_records(df: DataFrame, json: str) -> DataFrame:
    """Records as JSON text become columns of RECORD."""
    (r,) = temp_name(df, "r")
    names = {f.name for f in RECORD.fields}
    return df.withColumn(r, F.from_json(json, RECORD)).select(*[c for c in df.columns if c not in names], f"{r}.*")


def records_of_rows(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One ``messages`` record for each conversation of a table with a row per turn."""
    ordered = F.array_sort(F.collect_list(F.struct(turn, role, text)))
    return rows.groupBy(conv_id).agg(F.transform(ordered, lambda m: F.struct(m[role].alias("role"), m[text].alias("content"))).alias("messages"))


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, "$1$3\\\\$2$4")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    """Between doubled backslashes, a backslash either stands for a line feed, with an n after it, or goes."""
    parts = F.transform(F.split(role, r"\\\\", -1), lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\"), F.lit("")))
    return F.array_join(parts, "\\")


def format_turns(df: DataFrame, turns: str = "turns", trained: str = "assistant") -> DataFrame:
    """With ``formatted`` and ``loss_spans``: (turn, start, length) of the text that the loss covers, counted in code
    points from the start of the turn's own stretch of the formatted text."""
    head = lambda t: F.concat(F.lit(TURN), escape_role(t["role"]), F.lit("\n"))
    written = F.coalesce(F.array_join(F.transform(F.col(turns), lambda t: F.concat(head(t), escape(t["text"]), F.lit(END))), ""), F.lit(""))
    spans = F.transform(F.col(turns), lambda t, i: F.when(t["role"] == trained, F.struct(i.alias("turn"), F.length(head(t)).alias("start"), F.length(escape(t["text"])).alias("length"))))
    return df.withColumns({"formatted": written, "loss_spans": F.coalesce(F.array_compact(spans), F.array().cast("array<struct<turn:int,start:int,length:int>>"))})


def stretches(formatted: Column) -> Column:
    """The turns' stretches of a formatted text, without their ends."""
    return F.filter(F.split(formatted, r"<\|end\|>\n"), lambda s: s != "")


def read_turns(formatted: Column) -> Column:
    """The canonical turns again."""
    head = lambda s: F.substring_index(s, "\n", 1)
    role = lambda s: F.substring(head(s), len(TURN) + 1, F.length(head(s)))
    text = lambda s: F.substring(s, F.length(head(s)) + 2, F.length(s))
    return F.transform(stretches(formatted), lambda s: F.struct(unescape_role(role(s)).alias("role"), unescape(text(s)).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    parts = stretches(formatted)
    return F.array_join(F.transform(spans, lambda x: unescape(F.substring(F.element_at(parts, x["turn"] + 1), x["start"] + 1, x["length"]))), "")
