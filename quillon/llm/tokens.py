"""Token counts by a finite-state transducer compiled from a BPE vocabulary.

The vocabulary (pieces with scores, single characters beyond it falling back to bytes) is compiled into a deterministic
transducer over characters. Its transitions carry how many tokens the prefix read so far gains or loses; the sum over a
text is its token count, without building a token.

A state is what the future can depend on: the longest suffix that begins some piece, the last token of the segmentation
at each position of that suffix, and the token counts there. The last token at a new position is the one piece that ends
there and fits the last token where it begins; two tokens fit if merging their joined characters gives them back.
Where no piece holds two neighbouring characters, no merge crosses them, and the transducer is back at its start: a
synchronising point. States are made when first reached and kept within ``MAX_STATES``.

Long texts are cut into chunks that run in different tasks. What a chunk does to any incoming state is kept as (head,
count, tail): the characters up to its first synchronising point, the tokens from there to its last one, and the
characters after that. These maps compose associatively, so they are folded pairwise, like a prefix scan.

Defined results: a NULL or empty text has no bytes and no tokens; equal rows are counted one by one; an empty table gives
no rows; columns of the caller are kept but one with the name of the count, and the working columns avoid their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import temp_name

CHUNK = 1 << 16
MAX_STATES = 150_000
SPACE = "▁"


class Vocabulary:
    """Pieces and scores of a sentencepiece BPE model with byte fallback and an identity normaliser."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.scores = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        if any(c not in self.scores for p in self.scores for c in p):
            raise ValueError("a character of a piece is no piece of its own")

    def merge(self, text: str) -> list[str]:
        """Merges by falling score, leftmost first; for the few characters of two joined pieces."""
        parts = list(text)
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda i: (self.scores.get(parts[i] + parts[i + 1], float("-inf")), -i))
            if parts[best] + parts[best + 1] not in self.scores:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts


class State(dict):
    """Transitions by character; ``delta`` is the token count that entering this state adds."""

    __slots__ = ("machine", "suffix", "last", "counts", "delta")

    def __missing__(self, ch: str) -> State:
        self[ch] = to = self.machine.follow(self, ch)
        return to


class Transducer:
    def __init__(self, vocabulary: Vocabulary, max_states: int = MAX_STATES):
        self.vocabulary, self.max_states = vocabulary, max_states
        self.prefixes = {p[:k] for p in vocabulary.scores for k in range(1, len(p) + 1)}
        self.inside = {p[k : k + 2] for p in vocabulary.scores for k in range(len(p) - 1)}
        self.states: dict[tuple, State] = {}
        self.fits: dict[tuple[str | None, str], bool] = {}
        self.start = self.state("", (None,), (0,), 0)

    def state(self, suffix: str, last: tuple, counts: tuple, delta: int) -> State:
        key = (suffix, last, counts, delta)
        found = self.states.get(key)
        if found is None:
            found = State()
            found.machine, found.suffix, found.last, found.counts, found.delta = self, suffix, last, counts, delta
            if len(self.states) >= self.max_states:
                self.states.clear()
                self.start.clear()
            self.states[key] = found
        return found

    def fit(self, before: str | None, piece: str) -> bool:
        key = (before, piece)
        if key not in self.fits:
            if len(self.fits) > 4 * self.max_states:
                self.fits.clear()
            self.fits[key] = self.vocabulary.merge((before or "") + piece) == [x for x in key if x]
        return self.fits[key]

    def follow(self, at: State, ch: str) -> State:
        if ch not in self.vocabulary.scores:
            return self.state("", (None,), (0,), len(ch.encode("utf-8", "surrogatepass")))
        if at.suffix and at.suffix[-1] + ch not in self.inside:
            at = self.start
        read = at.suffix + ch
        cut = next(k for k in range(len(read)) if read[k:] in self.prefixes)
        for k in range(cut, len(read)):  # the longest piece that fits; only one does
            if read[k:] in self.vocabulary.scores and self.fit(at.last[k], read[k:]):
                delta = at.counts[k] + 1
                return self.state(read[cut:], (*at.last[cut:], read[k:]), (*(c - delta for c in at.counts[cut:]), 0), delta)
        raise AssertionError(f"no piece ends at {ch!r}")

    def count(self, text: str) -> int:
        s, n = self.start, 0
        for ch in text:
            s = s[ch]
            n += s.delta
        return n

    def chunk_map(self, text: str) -> tuple[str, int, str | None]:
        """(head, count, tail) of a chunk; without a synchronising point all of it is head, and the tail is None."""
        inside, n = self.inside, len(text)
        first = next((i for i in range(1, n) if text[i - 1 : i + 1] not in inside), None)
        if first is None:
            return text, 0, None
        last = next(i for i in range(n - 1, 0, -1) if text[i - 1 : i + 1] not in inside)
        return text[:first], self.count(text[first:last]), text[last:]

    def compose(self, a: tuple[str, int, str | None], b: tuple[str, int, str | None]) -> tuple[str, int, str | None]:
        """The map of two neighbouring chunks."""
        if a[2] is None:
            return a[0] + b[0], b[1], b[2]
        if b[2] is None:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + self.count(a[2] + b[0]) + b[1], b[2]

    def total(self, maps: list[tuple[str, int, str | None]]) -> int:
        """Folds the maps of a text pairwise; from the start state they give its token count."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, n, tail = maps[0]
        return self.count(head) + n + self.count(tail or "")


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One for each Python worker, so that states are shared by its tasks."""
    return Transducer(Vocabulary(path))


def escape(text: str) -> str:
    return text.replace(" ", SPACE)


def count_tokens(docs: DataFrame, path: str, text: str = "text", out: str = "n_tokens", chunk: int = CHUNK) -> DataFrame:
    """The caller's columns, with the token count of the whole text."""

    @F.pandas_udf(T.LongType())
    def whole(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = transducer(path)
        for batch in batches:
            yield pd.Series([machine.count(SPACE + escape(t)) if t else 0 for t in batch], dtype="int64")

    kind = T.StructType([T.StructField("head", T.StringType()), T.StructField("count", T.LongType()), T.StructField("tail", T.StringType())])

    def mapped(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        machine = transducer(path)
        for numbers, parts in columns:
            yield pd.DataFrame([machine.chunk_map((SPACE if i == 0 else "") + escape(t)) for i, t in zip(numbers, parts)], columns=kind.names)

    def folded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = transducer(path)
        for batch in batches:
            yield pd.Series([machine.total([(m["head"], m["count"], m["tail"]) for m in maps]) for maps in batch], dtype="int64")

    mapped.__annotations__ = {"columns": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    chunk_maps, fold = F.pandas_udf(mapped, kind), F.pandas_udf(folded, T.LongType())
    body = F.col(text)
    short = docs.where(body.isNull() | (F.length(body) <= chunk)).withColumn(out, whole(body))
    long = docs.where(F.length(body) > chunk)
    h, size, no, part, maps = temp_name(docs, "h", "size", "no", "part", "maps")
    # equal long texts are counted once, told apart by SHA-256
    key = F.sha2(body, 256)
    keyed = long.select(key.alias(h), F.length(body).alias(size), body.alias(text)).dropDuplicates([h, size])
    cuts = keyed.select(h, size, text, F.explode(F.sequence(F.lit(0), ((F.col(size) - 1) / chunk).cast("int"))).alias(no))
    parts = cuts.select(h, size, no, F.substring(F.col(text), F.col(no) * chunk + 1, F.lit(chunk)).alias(part)).repartition(h, size, no)
    done = parts.select(h, size, no, chunk_maps(F.col(no), F.col(part)).alias("m"))
    ordered = done.groupBy(h, size).agg(F.sort_array(F.collect_list(F.struct(no, "m.head", "m.count", "m.tail"))).alias(maps))
    totals = ordered.select(h, size, fold(F.col(maps)).alias(out))
    keep = [c for c in docs.columns if c.lower() != out.lower()]
    counted = long.drop(out).withColumns({h: key, size: F.length(body)}).join(totals, [h, size]).select(*keep, out)
    return short.select(*keep, out).unionByName(counted)
