"""Exact top-k inner products with a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it; a pivot's vectors fall into annuli (rings) of equal
width. For a query q and a vector x of a ring around p, the triangle inequality gives |q - x| >= | |q - p| - |x - p| |,
and so 2 q.x <= |q|^2 + |x|^2 - (gap between |q - p| and the ring)^2; also q.x <= q.p + |q| |x - p|. A query first
expands its rings in the order of these bounds until they hold k vectors: the k-th score found there is its floor. It
then visits the rings whose bound reaches the floor, and stops there; no skipped ring can hold a better score, so the
result is exact.

Pivots are fitted on a bounded sample (``SAMPLE`` vectors with the smallest hash of the id); every vector is indexed.
A pivot has at most ``MOST_RINGS`` rings; the last one holds all vectors beyond. Rings are packed into blocks of at most
``BLOCK_ROWS`` rows, and hot rings are split over several blocks. Queries are put into chunks of about ``QUERY_ROWS`` that
lie in neighbouring rings. A block is sent to the chunks that have a query which visits it, and to no other, so all
groups are bounded and pruned blocks are not copied. What the driver holds and broadcasts is one row per ring, at most
``N_PIVOTS`` * ``MOST_RINGS``. visited_share() tells how much of a full scan the bounds leave.

Defined results: vectors that are NULL, empty, or hold NULL, NaN or infinite components take no part; shorter vectors
count as padded with zeros; ties go to the smaller id, and equal (id, vector) rows are candidates of their own; a row
is no candidate of its own query, nor is any row of the same id; NULL ids take no part; a query with fewer than k
candidates gets all of them; equal query rows are one query, and query rows of one id with different vectors are one
query each, told apart by ``variant`` (from 0, in the order of the vectors); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

N_PIVOTS = 48
SAMPLE = 4096
RINGS = 16  # within the reach of the sample
MOST_RINGS = 64
BLOCK_ROWS = 4096
QUERY_ROWS = 4096
SEEDS = 4  # an exact floor needs k candidates; the first rings are visited until they hold so many times k


def scaled(embedding: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component, or NULL where the vector takes no part."""
    whole = F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(embedding.isNotNull() & (F.size(embedding) > 0) & ~F.coalesce(odd, F.lit(True)), whole)


def _matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def choose_pivots(sample: np.ndarray, n: int = N_PIVOTS) -> np.ndarray:
    """Farthest-first traversal from the vector nearest to the mean."""
    if not len(sample):
        return np.zeros((1, max(1, sample.shape[1] if sample.ndim == 2 else 1)))
    first = int(np.argmin(((sample - sample.mean(axis=0)) ** 2).sum(axis=1)))
    chosen = [first]
    far = ((sample - sample[first]) ** 2).sum(axis=1)
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = (x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(d, 0))


def index(vectors: DataFrame, pivots: np.ndarray, width: float) -> DataFrame:
    """(id, vec, is_query, pivot, ring, dist, norm) of every vector."""
    held = vectors.sparkSession.sparkContext.broadcast(pivots)

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = held.value
        for batch in batches:
            if len(batch):
                x = _matrix(batch["vec"], p.shape[1])
                d = _distances(x, p)
                at = d.argmin(axis=1)
                dist = d[np.arange(len(x)), at]
                yield pd.DataFrame({"id": batch["id"], "vec": batch["vec"], "is_query": batch["is_query"], "pivot": at, "ring": np.minimum(dist // width, MOST_RINGS - 1), "dist": dist, "norm": np.sqrt((x**2).sum(axis=1))})

    return vectors.mapInPandas(keyed, "id long, vec array<double>, is_query boolean, pivot int, ring int, dist double, norm double")


def pack(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Groups in order put into blocks of at most ``most`` rows: (first block, number of blocks) of each, and all blocks.

    A larger group gets blocks of its own, over which its rows are spread.
    """
    first, parts = np.zeros(len(counts), dtype=np.int64), np.ones(len(counts), dtype=np.int64)
    block, filled = -1, most
    for i, n in enumerate(counts):
        if filled + n > most:
            block, filled = block + 1, 0
        first[i] = block
        if n > most:
            parts[i] = -(-int(n) // most)
            block, filled = block + int(parts[i]) - 1, most
        filled += n
    return first, parts, block + 1


class Rings:
    """What the driver knows of the rings: their pivots, distances, largest norms, blocks, and chunks of queries."""

    def __init__(self, rows: list, pivots: np.ndarray, block_rows: int | None = None):
        rows = sorted(rows, key=lambda r: (r["pivot"], r["ring"]))
        self.pivots = pivots
        self.pivot = np.array([r["pivot"] for r in rows], dtype=np.int64)
        self.ring = np.array([r["ring"] for r in rows], dtype=np.int64)
        self.n = np.array([r["n"] for r in rows], dtype=np.int64)
        self.low, self.high = (np.array([r[k] for r in rows], dtype=float) for k in ("low", "high"))
        self.norm = np.array([r["norm"] for r in rows], dtype=float)
        self.first, self.parts, self.blocks = pack(self.n, block_rows or BLOCK_ROWS)
        self.first_chunk, self.chunk_parts, self.chunks = pack(np.array([r["queries"] for r in rows], dtype=np.int64), QUERY_ROWS)
        self.cell = np.full((len(pivots), MOST_RINGS), -1, dtype=np.int64)
        self.cell[self.pivot, self.ring] = np.arange(len(rows))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner products, query by ring. Rounding is allowed for; scores are whole numbers."""
        d = _distances(q, self.pivots)[:, self.pivot]
        norm = np.sqrt((q**2).sum(axis=1))[:, None]
        gap = np.maximum(0, np.maximum(self.low - d, d - self.high) - 1e-6)
        by_distance = (norm**2 + self.norm**2 - gap**2) / 2
        by_pivot = (q @ self.pivots.T)[:, self.pivot] + norm * self.high
        return np.minimum(by_distance, by_pivot) + 1e-3


SCORES = "query_id long, variant int, id long, score long"


class Search:
    """An index of the rows of a table, and the queries among them."""

    def __init__(self, table: DataFrame, vec: Column, is_query: Column, vec_id: str, k: int = 20, n_pivots: int = N_PIVOTS):
        self.k = k
        vectors = table.select(F.col(vec_id).cast("long").alias("id"), vec.alias("vec"), F.coalesce(is_query, F.lit(False)).alias("is_query")).where("id is not null and vec is not null")
        dim = vectors.agg(F.max(F.size("vec"))).first()[0] or 1
        sample = _matrix(vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").toPandas()["vec"], dim)
        pivots = choose_pivots(sample, n_pivots)
        reach = _distances(sample, pivots).min(axis=1) if len(sample) else np.zeros(1)
        self.indexed = cut(index(vectors, pivots, max(1.0, float(reach.max()) / RINGS)))
        rows = self.indexed.groupBy("pivot", "ring").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_query").cast("long")).alias("queries"), F.min("dist").alias("low"), F.max("dist").alias("high"), F.max("norm").alias("norm")).collect()
        self.rings = Rings(rows, pivots)
        self.held = table.sparkSession.sparkContext.broadcast(self.rings)
        each = self.indexed.where("is_query").select("id", "vec", "pivot", "ring").dropDuplicates(["id", "vec"])
        numbered = each.withColumn("variant", F.row_number().over(Window.partitionBy("id").orderBy("vec")) - 1)
        self.queries = numbered.mapInPandas(self._to_chunks(), "chunk long, id long, variant int, vec array<double>")
        self.blocked = cut(self.indexed.select("id", "vec", "pivot", "ring").mapInPandas(self._to_blocks(), "block long, cell long, id long, vec array<double>"))

    def _to_blocks(self):
        held = self.held

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            r = held.value
            for batch in batches:
                cell = r.cell[batch["pivot"].to_numpy(), batch["ring"].to_numpy()]
                salt = (batch["id"].to_numpy() * 2654435761 + np.arange(len(batch)) >> 7) % r.parts[cell] if len(cell) else cell
                yield pd.DataFrame({"block": r.first[cell] + salt, "cell": cell, "id": batch["id"], "vec": batch["vec"]})

        return run

    def _to_chunks(self):
        held = self.held

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            r = held.value
            for batch in batches:
                cell = r.cell[batch["pivot"].to_numpy(), batch["ring"].to_numpy()]
                salt = (batch["id"].to_numpy() * 2654435761 >> 7) % r.chunk_parts[cell] if len(cell) else cell
                yield pd.DataFrame({"chunk": r.first_chunk[cell] + salt, "id": batch["id"], "variant": batch["variant"], "vec": batch["vec"]})

        return run

    def visits(self, rows: DataFrame, first: bool) -> DataFrame:
        """Query rows by the blocks they visit: the best rings that hold enough vectors, or all that reach the floor."""
        held, k = self.held, self.k

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            r = held.value
            for batch in batches:
                for i in range(0, len(batch), 512):
                    part = batch.iloc[i : i + 512]
                    at, to = [], []
                    bound = r.bounds(_matrix(part["vec"], r.pivots.shape[1]))
                    for j in range(len(part)):
                        if first:
                            best = np.argsort(-bound[j], kind="stable")
                            cells = best[: int(np.searchsorted(r.n[best].cumsum(), SEEDS * k)) + 1]
                            seen = {int(b) for b in r.first[cells]}  # one part of a split ring is enough for a floor
                        else:
                            floor = part["floor"].iloc[j]
                            cells = np.flatnonzero(bound[j] >= (-np.inf if np.isnan(floor) else floor))
                            seen = {int(b) for c in cells for b in range(r.first[c], r.first[c] + r.parts[c])}
                        at.extend([j] * len(seen))
                        to.extend(sorted(seen))
                    out = part.iloc[at]
                    yield pd.DataFrame({"block": np.array(to, dtype=np.int64), "chunk": out["chunk"].to_numpy(), "query_id": out["id"].to_numpy(), "variant": out["variant"].to_numpy(), "floor": out["floor"].to_numpy(), "vec": out["vec"].to_numpy()})

        return rows.mapInPandas(run, "block long, chunk long, query_id long, variant int, floor double, vec array<double>")

    def sent(self, at: DataFrame) -> DataFrame:
        """The vectors of each block, once for each chunk of queries that visits it."""
        pairs = at.select(F.col("block").alias("to_block"), F.col("chunk").alias("to_chunk")).distinct()
        met = self.blocked.join(pairs, F.col("block") == F.col("to_block"))
        return met.select("block", F.col("to_chunk").alias("chunk"), "cell", "id", "vec")

    def _scorer(self):
        held, k = self.held, self.k

        def scores(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            """The k best of one block for each query, ring by ring, without rings and rows below its floor."""
            r = held.value
            found = []
            if len(left) and len(right):
                q = _matrix(left["vec"], r.pivots.shape[1])
                floor = left["floor"].fillna(-np.inf).to_numpy()
                cell, ids = right["cell"].to_numpy(), right["id"].to_numpy()
                x = _matrix(right["vec"], r.pivots.shape[1])
                bound = r.bounds(q)
                order = np.argsort(ids, kind="stable")
                cell, ids, x = cell[order], ids[order], x[order]
                own, variant = left["query_id"].to_numpy(), left["variant"].to_numpy()
                cells = np.unique(cell)
                for i in range(0, len(q), 256):
                    rows = slice(i, i + 256)
                    near = bound[rows][:, cells] >= floor[rows, None]
                    take = np.isin(cell, cells[near.any(axis=0)])
                    if not take.any():
                        continue
                    s = q[rows] @ x[take].T
                    s[own[rows, None] == ids[take][None]] = -np.inf
                    for j in range(len(s)):
                        # ids are in order, so a stable sort leaves ties to the smaller one
                        good = np.flatnonzero((s[j] >= floor[i + j]) & (s[j] > -np.inf))
                        if len(good) > 4 * k:
                            kth = np.partition(s[j][good], len(good) - k)[len(good) - k]
                            good = good[s[j][good] >= kth]
                        best = good[np.argsort(-s[j][good], kind="stable")][:k]
                        found.append((np.full(len(best), own[i + j]), np.full(len(best), variant[i + j]), ids[take][best], s[j][best]))
            names = ("query_id", "variant", "id", "score")
            if not found:
                return pd.DataFrame({n: np.zeros(0, np.int64) for n in names})
            return pd.DataFrame({n: np.concatenate([f[i] for f in found]).astype(np.int64) for i, n in enumerate(names)})

        return scores

    def visit(self, rows: DataFrame, first: bool) -> DataFrame:
        at = self.visits(rows, first)
        met = at.groupBy("block", "chunk").cogroup(self.sent(at).groupBy("block", "chunk")).applyInPandas(self._scorer(), SCORES)
        best = Window.partitionBy("query_id", "variant").orderBy(F.desc("score"), "id")
        return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= self.k)

    def with_floors(self) -> DataFrame:
        """Queries with the k-th score of their first visit; NULL where it holds fewer candidates."""
        seeds = self.visit(self.queries.withColumn("floor", F.lit(None).cast("double")), True)
        floors = seeds.where(F.col("rank") == self.k).select(F.col("query_id").alias("id"), "variant", F.col("score").cast("double").alias("floor"))
        return cut(self.queries.join(floors, ["id", "variant"], "left"))


def top_k(table: DataFrame, vec: Column, is_query: Column, vec_id: str, k: int = 20, n_pivots: int = N_PIVOTS) -> DataFrame:
    """(query_id, variant, rank, id, score): for each query row the k rows of other ids with the largest inner products."""
    search = Search(table, vec, is_query, vec_id, k, n_pivots)
    return search.visit(search.with_floors(), False).select("query_id", "variant", "rank", "id", "score")


def visited_share(table: DataFrame, vec: Column, is_query: Column, vec_id: str, k: int = 20, n_pivots: int = N_PIVOTS) -> tuple[float, float]:
    """Of all pairs of a block and a query, and of a block and a chunk, the shares that the last visit has."""
    search = Search(table, vec, is_query, vec_id, k, n_pivots)
    at = search.visits(search.with_floors(), False).select("block", "chunk")
    pairs, sent = at.count(), at.distinct().count()
    return pairs / max(1, search.queries.count() * search.rings.blocks), sent / max(1, search.rings.chunks * search.rings.blocks)
