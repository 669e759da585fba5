"""Toxicity by weak supervision.

1. Voters. On a bounded sample of labelled training rows, words and word beginnings are counted in toxic and clean texts
   (in Spark). Those that stand in toxic texts more often than chance lets any of them become voters: exact words are
   lexicon voters, beginnings (that occur, are frequent, or are frequent and repeated) are pattern voters. A voter speaks
   for toxic where it occurs; that it is silent speaks for clean as far as its rates tell.
2. Label model. A generative model of the votes with the true label hidden. Voters that speak together more than the
   label explains are correlated (a word and its beginnings): given the label, each voter depends on the one voter that
   tells most about it and speaks with it, so that the votes form trees; those of largest conditional mutual information are taken. EM
   estimates how often each voter speaks in toxic and in clean texts, where the voter it depends on speaks and where it
   doesn't: accuracies and correlations are parameters of one likelihood.
3. Classifier. A logistic regression over the same words and beginnings is trained on the posterior labels. It
   scores every text, whole; a score needs nothing but the text.

``MAX_TRAIN`` bounds the labelled rows that are used (those with the smallest hash of the id). The driver holds the votes of
these rows and a few numbers per voter; pairs of voters are counted in tasks, and only pairs that speak together, so nothing
is as large as the voters squared. No voter or feature that passes the test is left out.

Defined results: a NULL or empty text gets the score of a text without any known word; equal texts get equal scores;
labelled ids without a document, NULL labels and NULL ids are not used; without labels of both kinds every score is 0, and
without a telling word it is the sample's share of toxic rows; an empty table gives no rows; columns of the caller are
kept, but one with the name of the score is replaced by it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, temp_name

MAX_TRAIN = 30_000
THRESHOLD = 0.7
PREFIXES = (3, 4, 5, 6, 7)
RATE = 0.01  # of the words of a text: a beginning is frequent from here
FLUSH = 300_000
MEMO = 200_000

_LETTERS = re.compile(r"[^\W\d_]+")


def beginnings(word: str) -> list[str]:
    return [word[:k] for k in PREFIXES if len(word) > k]


def marks(start: str, n: int, words: int) -> list[str]:
    """What a beginning that n of the words have stands for: it occurs, it is frequent, it is frequent and repeated."""
    if n < RATE * words:
        return [f"{start}*"]
    return [f"{start}*", f"{start}*%"] if n < 2 else [f"{start}*", f"{start}*%", f"{start}*%%"]


def text_features(text: str | None) -> set[str]:
    counts = Counter(_LETTERS.findall((text or "").lower()))
    words, starts = counts.total(), Counter()
    for w, n in counts.items():
        for s in beginnings(w):
            starts[s] += n
    found = set(counts)
    for s, n in starts.items():
        found.update(marks(s, n, words))
    return found


@dataclass
class Model:
    """Weights of the classifier by feature; voters are the features the label model used."""

    weights: dict[str, float]
    intercept: float
    voters: list[str]
    accuracies: dict[str, float]

    def __post_init__(self) -> None:
        self.starts = {f.rstrip("%")[:-1] for f in self.weights if f.rstrip("%").endswith("*")}

    def score(self, text: str | None, memo: dict[str, tuple[str, ...]]) -> float:
        """memo: the beginnings of known words that have a weight; bounded, and kept from text to text."""
        weights, found = self.weights, _LETTERS.findall((text or "").lower())
        starts: Counter = Counter()
        z = [self.intercept]
        for w, n in Counter(found).items():
            if w in weights:
                z.append(weights[w])
            got = memo.get(w)
            if got is None:
                got = tuple(s for s in beginnings(w) if s in self.starts)
                if len(memo) < MEMO:
                    memo[w] = got
            for s in got:
                starts[s] += n
        for s, n in starts.items():
            z.extend(weights.get(f, 0.0) for f in marks(s, n, len(found)))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, math.fsum(z)))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> DataFrame:
    """(text, toxic) of at most ``limit`` labelled rows outside the held-out third, each text once."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.select("doc_id", F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy(F.xxhash64("text").alias("h"), "toxic").agg(F.first("text").alias("text")).select("text", "toxic")


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen = {0: Counter(), 1: Counter()}

    def flushed() -> pd.DataFrame:
        rows = [(f, y, n) for y, c in seen.items() for f, n in c.items()]
        for c in seen.values():
            c.clear()
        return pd.DataFrame(rows, columns=["feature", "toxic", "n"])

    for batch in batches:
        for text, y in zip(batch["text"], batch["toxic"]):
            seen[int(y > 0)].update(text_features(text))
            if sum(map(len, seen.values())) > FLUSH:
                yield flushed()
    yield flushed()


def _hits(names: list[str]):
    index = {f: i for i, f in enumerate(names)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [sorted(index[f] for f in text_features(t) if f in index) for t in batch["text"]]
            yield pd.DataFrame({"hits": found, "toxic": batch["toxic"] > 0})

    return run


def pair_counts(hits: Iterator[tuple[np.ndarray, float]], k: int, most: int = 4_000_000, slice_: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i * k + j, toxic, clean) of pairs i < j of voters that speak in one row, summed now and then; rows of (voters, how toxic)."""
    codes, weights, size = [], [], 0

    def summed():
        every, at = np.unique(np.concatenate(codes), return_inverse=True)
        weight = np.concatenate(weights)
        toxic = np.bincount(at, weights=weight, minlength=len(every))
        return every, toxic, np.bincount(at, minlength=len(every)) - toxic

    for said, q in hits:
        said = np.sort(np.asarray(said, dtype=np.int64))
        for a in range(0, len(said) - 1, slice_):  # a very long text has many voters
            first = said[a : a + slice_]
            i, j = np.nonzero(np.arange(a, a + len(first))[:, None] < np.arange(len(said))[None])
            codes.append(first[i] * k + said[j])
            weights.append(np.full(len(i), q))
            size += len(i)
            if size >= most:
                yield summed()
                codes, weights, size = [], [], 0
    if size:
        yield summed()


def gains(i: np.ndarray, j: np.ndarray, together: tuple[np.ndarray, np.ndarray], on: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Conditional mutual information of pairs given the label (times the rows); clean and toxic: pairs, votes of each voter, rows."""
    gain = np.zeros(len(i))
    for c in (0, 1):
        both, a, b, rows = np.asarray(together[c], dtype=float), on[c][i], on[c][j], n[c]
        for seen, x, y in ((both, a, b), (a - both, a, rows - b), (b - both, rows - a, b), (rows - a - b + both, rows - a, rows - b)):
            gain += np.where(seen > 1e-3, seen * np.log(np.maximum(seen, 1e-9) * rows / np.maximum(x * y, 1e-9)), 0)
    return gain


def least_gain(k: int) -> float:
    """Dependencies that chance would bring about for one of all pairs are left out."""
    return math.log(max(2, k * (k - 1) / 2)) + 1


def forest(i: np.ndarray, j: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """The pairs of a spanning forest of largest gain, of equal ones the first. The forest of several forests' pairs is that of all."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    kept = []
    for e in np.lexsort((j, i, -gain)):
        a, b = find(int(i[e])), find(int(j[e]))
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append(e)
    return np.array(kept, dtype=np.int64)


def rooted(i: np.ndarray, j: np.ndarray, k: int) -> np.ndarray:
    """The voter that each voter depends on, or -1: trees hang from their first voter."""
    near: dict[int, list[int]] = {}
    for a, b in zip(i.tolist(), j.tolist()):
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    parent, seen = np.full(k, -1), np.zeros(k, dtype=bool)
    for first in range(k):
        if not seen[first] and first in near:
            seen[first], todo = True, [first]
            while todo:
                x = todo.pop()
                for y in near[x]:
                    if not seen[y]:
                        seen[y], parent[y] = True, x
                        todo.append(y)
    return parent


def dependencies(votes: np.ndarray, said: np.ndarray, n_rows: int, k: int, q: np.ndarray) -> np.ndarray:
    """The voter that each voter depends on, or -1: a forest of largest conditional mutual information given the label.

    ``votes``/``said``: row and voter of each vote; q: how sure it is that a row is toxic. Voters that never speak together
    do not depend on each other. This is for votes in one place; tree_of() does the same in Spark.
    """
    order = np.argsort(votes, kind="stable")
    cut_at = np.searchsorted(votes[order], np.arange(n_rows + 1))
    rows = ((said[order][a:b], float(x)) for a, b, x in zip(cut_at, cut_at[1:], q))
    found = list(pair_counts(rows, k))
    if not found:
        return np.full(k, -1)
    code, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    toxic, clean = (np.bincount(at, weights=np.concatenate([f[c] for f in found])) for c in (1, 2))
    on = np.array([np.bincount(said, weights=w[votes], minlength=k) for w in (1 - q, q)])
    i, j = code // k, code % k
    gain = gains(i, j, (clean, toxic), on, np.array([n_rows - q.sum(), q.sum()]))
    good = gain > least_gain(k)
    i, j, gain = i[good], j[good], gain[good]
    kept = forest(i, j, gain)
    return rooted(i[kept], j[kept], k)


def tree_of(hits: DataFrame, k: int, on: np.ndarray, n: np.ndarray) -> np.ndarray:
    """dependencies() of rows (hits, toxic), counted sparsely in Spark.

    Pairs are summed in tasks, then by pair; each task passes on the forest of its pairs, fewer than k, and the driver takes
    the forest of these. What it holds grows with the voters, not with their pairs. ``on``: votes of each voter in clean and
    in toxic rows; ``n``: the rows.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((h, float(y)) for batch in batches for h, y in zip(batch["hits"], batch["toxic"]))
        for code, toxic, clean in pair_counts(rows, k):
            yield pd.DataFrame({"pair": code, "toxic": toxic, "clean": clean})

    def weighed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = pd.DataFrame({"i": [], "j": [], "gain": []})
        for batch in batches:
            i, j = batch["pair"].to_numpy() // k, batch["pair"].to_numpy() % k
            gain = gains(i, j, (batch["clean"].to_numpy(), batch["toxic"].to_numpy()), on, n)
            good = gain > least_gain(k)
            more = pd.DataFrame({"i": i[good], "j": j[good], "gain": gain[good]})
            if len(more):
                kept = pd.concat([kept, more], ignore_index=True) if len(kept) else more
                kept = kept.iloc[forest(kept["i"].to_numpy(np.int64), kept["j"].to_numpy(np.int64), kept["gain"].to_numpy())].reset_index(drop=True)
        yield kept

    pairs = hits.mapInPandas(counted, "pair long, toxic double, clean double").groupBy("pair").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    edges = pairs.mapInPandas(weighed, "i long, j long, gain double").toPandas()
    kept = forest(edges["i"].to_numpy(), edges["j"].to_numpy(), edges["gain"].to_numpy())
    return rooted(edges["i"].to_numpy()[kept], edges["j"].to_numpy()[kept], k)


@dataclass
class Rates:
    """How often voters speak: by label (0 clean, 1 toxic), and whether the voter they depend on is silent or speaks."""

    parent: np.ndarray
    free: np.ndarray  # label, voter
    tied: np.ndarray
    prior: float

    def log_odds(self, votes: np.ndarray, said: np.ndarray, with_parent: np.ndarray, n_rows: int) -> np.ndarray:
        """Of toxic against clean, for each row; rows and voters of the votes, and whether the voter depended on speaks too."""
        on = [np.log(x[1] / x[0]) for x in (self.free, self.tied)]
        off = [np.log((1 - x[1]) / (1 - x[0])) for x in (self.free, self.tied)]
        has = self.parent >= 0
        # a row without votes, then what each vote changes: at the voter, and at those that depend on it and are silent
        below = np.bincount(self.parent[has], weights=(off[1] - off[0])[has], minlength=len(has))
        # a voter that speaks with its parent was counted among the silent ones below the parent
        change = np.where(with_parent, (on[1] - off[1])[said], (on[0] - off[0])[said])
        return math.log(self.prior / (1 - self.prior)) + off[0].sum() + np.bincount(votes, weights=change + below[said], minlength=n_rows)


def estimate(votes: np.ndarray, said: np.ndarray, with_parent: np.ndarray, parent: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> Rates:
    """The rates of largest likelihood if rows are toxic and clean with these weights, a little smoothed."""
    k, made = len(parent), []
    for weight in (clean, toxic):
        on = np.bincount(said, weights=weight[votes], minlength=k)
        both = np.bincount(said, weights=weight[votes] * with_parent, minlength=k)
        above = np.where(parent >= 0, on[parent], 0.0)
        made.append(((on - both + 0.02) / (weight.sum() - above + 2), (both + 0.5) / (above + 1)))
    free, tied = (np.clip(np.array(x), 1e-5, 1 - 1e-3) for x in zip(*made))
    return Rates(parent, free, tied, float(np.clip(toxic.sum() / max(1e-9, (toxic + clean).sum()), 1e-3, 0.5)))


def label_model(votes: np.ndarray, said: np.ndarray, n_rows: int, k: int, gold: np.ndarray, rounds: int = 12, trust: float = 1.0, parent: np.ndarray | None = None) -> tuple[np.ndarray, Rates]:
    """Posterior labels and rates. EM starts from the sample's labels, which stay one more observer, worth ``trust`` posteriors."""
    if parent is None:
        parent = dependencies(votes, said, n_rows, k, gold)
    keys = np.sort(votes * k + said)
    above = votes * k + parent[said]
    at = np.minimum(np.searchsorted(keys, above), max(0, len(keys) - 1))
    with_parent = (parent[said] >= 0) & (keys[at] == above) if len(keys) else np.zeros(0, dtype=bool)
    q = gold
    for _ in range(rounds):
        rates = estimate(votes, said, with_parent, parent, q + trust * gold, 1 - q + trust * (1 - gold))
        q = 1 / (1 + np.exp(-np.clip(rates.log_odds(votes, said, with_parent, n_rows), -60, 60)))
    return q, rates


def logistic(rows: np.ndarray, cols: np.ndarray, n: int, k: int, target: np.ndarray, rounds: int = 800, l2: float = 1e-6) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels over a sparse 0/1 matrix, by Adam on the whole sample."""
    w = np.zeros(k + 1)
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, rounds + 1):
        z = w[k] + np.bincount(rows, weights=w[cols], minlength=n)
        err = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - target
        g = np.append(np.bincount(cols, weights=err[rows], minlength=k), err.sum()) / n + l2 * np.append(w[:k], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w[:k], float(w[k])


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> Model | None:
    sample = cut(training_rows(docs, labels, limit))
    sizes = {bool(r[0]): r[1] for r in sample.groupBy(F.col("toxic") > 0).count().collect()}
    pos, neg = sizes.get(True, 0), sizes.get(False, 0)
    if not pos or not neg:
        return None
    counts = cut(sample.mapInPandas(_count, "feature string, toxic int, n long").groupBy("feature").agg(F.sum(F.expr("if(toxic = 1, n, 0)")).alias("p"), F.sum(F.expr("if(toxic = 0, n, 0)")).alias("q")))
    prior = pos / (pos + neg)
    p, q = F.col("p"), F.col("q")
    surprise = F.when(p > 0, p * F.log(p / (p + q) / prior)).otherwise(0.0) + F.when(q > 0, q * F.log(q / (p + q) / (1 - prior))).otherwise(0.0)
    # a bar that chance would let about one of all counted features pass
    bar = math.log(max(2, counts.count()))
    names = [r["feature"] for r in counts.where((surprise >= bar) & (p > prior * (p + q))).select("feature").orderBy("feature").collect()]
    if not names:
        return Model({}, math.log(prior / (1 - prior)), [], {})
    hits = cut(sample.select("text", "toxic").mapInPandas(_hits(names), "hits array<int>, toxic boolean"))
    got = hits.toPandas()
    n, k = len(got), len(names)
    votes = np.repeat(np.arange(n), [len(h) for h in got["hits"]])
    said = np.concatenate([np.asarray(h, dtype=np.int64) for h in got["hits"]])
    gold = got["toxic"].to_numpy().astype(float)
    on = np.array([np.bincount(said, weights=x[votes], minlength=k) for x in (1 - gold, gold)])
    parent = tree_of(hits, k, on, np.array([n - gold.sum(), gold.sum()]))
    posterior, rates = label_model(votes, said, n, k, gold, parent=parent)
    w, intercept = logistic(votes, said, n, k, posterior)
    a, b = (np.bincount(said, weights=x[votes], minlength=k) / max(1e-9, x.sum()) for x in (posterior, 1 - posterior))
    return Model({f: float(x) for f, x in zip(names, w)}, intercept, names, {f: float(max(x, y) / max(1e-9, x + y)) for f, x, y in zip(names, a, b)})


def score(docs: DataFrame, model: Model | None, text: str = "text", out: str = "score") -> DataFrame:
    if model is None:
        return docs.withColumn(out, F.lit(0.0))
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            yield pd.Series([held.value.score(t, memo) for t in batch], dtype="float64")

    return docs.withColumn(out, scored(F.col(text)))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents scored below the threshold, with the caller's columns."""
    (mark,) = temp_name(docs, "toxicity")
    return score(docs, fit(docs, labels), out=mark).where(F.col(mark) < threshold).drop(mark)
