"""Approximate nearest neighbours by balanced posting lists.

* Centroids come from a bounded sample (``SAMPLE_NUMBERS`` components, the rows with the smallest hashes of their ids) by
  halving it again and again at the median between two means, so that lists hold about equal numbers of rows.
* Every row goes to the list of its nearest centroid. A boundary vector, about as near to further centroids (within
  ``CLOSE``), is replicated to up to ``REPLICAS`` lists, save those whose centroid lies nearer to one taken already.
* A query finds centroids in a graph that tasks hold in memory: each centroid is tied to near ones in different
  directions, and the search expands the nearest unexpanded node until all nodes within the ratio are expanded.
* Distance-ratio pruning: the lists visited are those whose centroid is at most ``ratio`` times as far as the nearest one,
  and the nearest ones until they hold k other rows.
  The ratio is calibrated: ``PROBES`` different sample rows search the whole table by brute force (one pass, merged by groups), and
  the ratio is the least that finds ``RECALL`` of their neighbours. So clustered tables visit few lists, and tables
  without clusters as many as they need.
* Lists are packed into blocks of at most ``BLOCK_ROWS`` rows (long lists are split), queries into chunks near each other;
  a block is sent to the chunks that visit it. Distances are computed again from the original vectors, in double precision.

The driver holds the sample, the centroids (at most ``MAX_LISTS``), their graph, and one count per list; the broadcast is
centroids and graph. Work is the share of lists that the ratio leaves; recall() measures what is found.

Defined results: vectors that are NULL, empty, zero, or hold NULL, NaN or infinite components take no part; shorter vectors
count as padded with zeros; ties go to the smaller id; equal rows are candidates of their own; no row with the query's id is
its candidate; rows without id take no part; equal query rows are one query, and those of one id with different vectors are
told apart by ``variant``; a query gets all candidates found if fewer than k; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .topk import pack

SAMPLE_NUMBERS = 1 << 22
LIST_ROWS = 160
MAX_LISTS = 4096
FIT_ROWS = 16  # sample rows a list at least
REPLICAS = 4
CLOSE = 1.1
DEGREE = 16
BEAM = 32
PROBES = 256
RECALL = 0.97
BLOCK_ROWS = 4096
QUERY_ROWS = 4096


def usable(embedding: Column) -> Column:
    """The vector as doubles, or NULL where it takes no part."""
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(embedding, lambda x: x != 0)
    return F.when(embedding.isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.coalesce(some, F.lit(False)), embedding.cast("array<double>"))


def matrix(vectors: pa.ListArray | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors as rows, padded with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks() if vectors.num_chunks else pa.array([], vectors.type)
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all pairs of rows; the last digits are lost near zero."""
    d = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(np.nan_to_num(d, nan=np.inf, posinf=np.inf), 0))


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(axis=1))


def balanced_centroids(x: np.ndarray, n: int) -> np.ndarray:
    """Means of n parts of nearly equal size, cut in halves at the median between two means."""
    out, parts = [], [(np.arange(len(x)), n)]
    while parts:
        rows, k = parts.pop()
        if k <= 1 or len(rows) < 2:
            out.append(x[rows].mean(axis=0))
            continue
        at = x[rows]
        far = at[distances(at.mean(axis=0)[None], at)[0].argmax()]
        near = at[distances(far[None], at)[0].argmax()]
        half = len(rows) * (k // 2) // k
        for _ in range(6):
            order = np.argsort(at @ (near - far), kind="stable")
            far, near = at[order[:half]].mean(axis=0), at[order[half:]].mean(axis=0)
        parts += [(rows[order[:half]], k // 2), (rows[order[half:]], k - k // 2)]
    return np.unique(np.array(out), axis=0)


def link(centroids: np.ndarray) -> np.ndarray:
    """Up to ``DEGREE`` links of each centroid, to near ones none of which lies nearer to another; the chain of ids keeps all within reach."""
    n = len(centroids)
    links = np.repeat(np.arange(n)[:, None], DEGREE + 2, axis=1)
    between = distances(centroids, centroids)
    for i in range(n):
        taken: list[int] = []
        order = np.argsort(between[i], kind="stable")
        for j in order[order != i]:
            if len(taken) < DEGREE // 2 and all(between[i, j] < between[t, j] for t in taken):
                taken.append(j)
            if len(taken) == DEGREE // 2:
                break
        spare = [j for j in order[1 : DEGREE + 1] if j != i and j not in taken]
        taken += spare[: DEGREE - len(taken)]
        links[i, : len(taken)] = taken
        links[i, DEGREE:] = ((i + 1) % n, (i - 1) % n)
    return links


class Lists:
    """Centroids, their graph, and the ratio within which lists are visited."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.links = link(centroids)
        self.entry = int(distances(centroids.mean(axis=0)[None], centroids)[0].argmin())
        self.between = distances(centroids, centroids) if len(centroids) > 1 else np.zeros((1, 1))
        self.ratio = 1.0
        self.sizes = np.zeros(len(centroids), dtype=np.int64)  # rows of each list
        self.least = 0  # a query visits the nearest lists until they hold so many rows, whatever the ratio

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The lists of each row, nearest first; -1 where it has fewer than ``REPLICAS``."""
        out = np.full((len(x), REPLICAS), -1, dtype=np.int64)
        for start in range(0, len(x), 1024):
            d = distances(x[start : start + 1024], self.centroids)
            width = min(4 * REPLICAS, d.shape[1])
            near = np.argpartition(d, width - 1, axis=1)[:, :width]
            near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, axis=1), axis=1, kind="stable"), axis=1)
            own = np.take_along_axis(d, near, axis=1)
            rows = np.arange(len(d))
            part = out[start : start + 1024]
            part[:, 0] = near[:, 0]
            count = np.ones(len(d), dtype=np.int64)
            for r in range(1, width):
                apart = self.between[near[:, r, None], part]
                hidden = ((apart < own[:, r, None]) & (part >= 0)).any(axis=1)
                take = (own[:, r] <= CLOSE * own[:, 0]) & ~hidden & (count < REPLICAS)
                part[rows[take], count[take]] = near[take, r]
                count += take
        return out

    def found(self, q: np.ndarray, ratio: float) -> np.ndarray:
        """Distances of the queries to the centroids that the graph search comes to, else infinite."""
        n, known = len(q), np.full((len(q), len(self.centroids)), np.inf)
        waiting = known.copy()  # the same, without expanded nodes
        first = exact(self.centroids[self.entry], q)
        known[:, self.entry] = waiting[:, self.entry] = first
        best = first.copy()
        for step in range(len(self.centroids)):
            node = waiting.argmin(axis=1)
            at = waiting[np.arange(n), node]
            active = np.flatnonzero(np.isfinite(at) & ((at <= ratio * best) | (step < BEAM)))
            if not len(active):
                break
            waiting[active, node[active]] = np.inf
            to = self.links[node[active]]
            d = np.sqrt(((self.centroids[to] - q[active, None]) ** 2).sum(axis=2))
            new = np.isinf(known[active[:, None], to])
            waiting[active[:, None], to] = np.where(new, d, waiting[active[:, None], to])
            known[active[:, None], to] = d
            best[active] = np.minimum(best[active], d.min(axis=1))
        return known

    def visited(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, list) pairs within the ratio or needed for ``least`` rows, and each query's nearest list."""
        d = self.found(q, self.ratio)
        near = np.argsort(d, axis=1, kind="stable")
        sorted_ = np.take_along_axis(d, near, axis=1)
        held = self.sizes[near]
        before = held.cumsum(axis=1) - held
        rows, place = np.nonzero((sorted_ <= self.ratio * sorted_[:, :1]) | ((before < self.least) & np.isfinite(sorted_)))
        return rows, near[rows, place], near[:, 0]


def _nearest(q: np.ndarray, ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, allowed: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its number, and the places and distances of its k nearest rows, ties to the smaller id."""
    for start in range(0, len(q), 256):
        part = slice(start, start + 256)
        d = distances(q[part], x)
        d[ids[part, None] == x_ids[None]] = np.nan
        if allowed is not None:
            d[~allowed[part]] = np.nan
        slack = 1e-6 * (np.abs(q[part]).max(axis=1) + np.abs(x).max()) * q.shape[1]
        for i in range(len(d)):
            open_ = np.flatnonzero(~np.isnan(d[i]))
            if len(open_) > k:
                kth = np.partition(d[i][open_], k - 1)[k - 1]
                open_ = open_[d[i][open_] <= kth + slack[i]]
            score = exact(q[start + i], x[open_])
            order = np.lexsort((x_ids[open_], score))[:k]
            yield start + i, open_[order], score[order]


class Index:
    """Posting lists of the rows of a table."""

    def __init__(self, table: DataFrame, vec: Column, vec_id: str, k: int):
        self.k = k
        rows = table.select(F.col(vec_id).cast("long").alias("id"), vec.alias("vec")).where("id is not null and vec is not null")
        self.rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
        total, dim = self.rows.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
        self.dim = dim or 1
        by_hash = self.rows.orderBy(F.xxhash64("id"), "id", "row").limit(max(64, SAMPLE_NUMBERS // self.dim))
        held = by_hash.select("id", "vec").toArrow()
        sample = matrix(held.column("vec"), self.dim)
        distinct = np.unique(sample, axis=0) if len(sample) else np.zeros((1, self.dim))
        lists = Lists(balanced_centroids(distinct, max(1, min(total // LIST_ROWS, MAX_LISTS, len(distinct) // FIT_ROWS))))
        if len(sample):
            probes = np.sort(np.unique(sample, axis=0, return_index=True)[1])[:PROBES]  # copies are one probe
            lists.ratio = self._calibrated(lists, sample[probes], held.column("id").to_numpy()[probes])
        self.lists = lists
        spark = table.sparkSession
        self.held = spark.sparkContext.broadcast(lists)
        self.posted = cut(self.rows.mapInArrow(self._post(), "list int, id long, row long, vec array<double>"))
        lists.sizes, lists.least = self.counts(self.posted), REPLICAS * (k + 1)  # a row is in REPLICAS lists at most
        self.held = spark.sparkContext.broadcast(lists)

    def _calibrated(self, lists: Lists, q: np.ndarray, ids: np.ndarray) -> float:
        """The least ratio that finds ``RECALL`` of the probes' true neighbours."""
        held = self.rows.sparkSession.sparkContext.broadcast((lists, q, ids))
        k, dim = self.k, self.dim

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lists, q, ids = held.value
            for batch in batches:
                if batch.num_rows:
                    x, x_ids = matrix(batch.column("vec"), dim), batch.column("id").to_numpy()
                    for i, at, score in _nearest(q, ids, x, x_ids, k):
                        near = lists.assign(x[at])
                        d = np.where(near >= 0, exact(q[i], lists.centroids[near.ravel()]).reshape(near.shape), np.inf).min(axis=1, initial=np.inf)
                        yield pa.RecordBatch.from_pydict({"probe": np.full(len(at), i), "id": x_ids[at], "score": score, "list_distance": d})

        found = self.rows.select("id", "vec").mapInArrow(scan, "probe long, id long, score double, list_distance double")
        best = Window.partitionBy("probe").orderBy("score", "id")
        near = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("probe", "list_distance").toArrow()  # at most PROBES * k rows
        if not near.num_rows:
            return 1.0
        least = distances(q, lists.centroids).min(axis=1)[near.column("probe").to_numpy()]
        ratios = np.sort(near.column("list_distance").to_numpy() / np.maximum(least, 1e-300))
        return float(ratios[min(len(ratios) - 1, int(np.ceil(RECALL * len(ratios))))]) * (1 + 1e-9)

    def _post(self):
        held, dim = self.held, self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = held.value.assign(matrix(batch.column("vec"), dim))
                row, rank = np.nonzero(at >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(at[row, rank].astype(np.int32)), *(batch.column(c).take(pa.array(row)) for c in ("id", "row", "vec"))], names=["list", "id", "row", "vec"])

        return run

    def counts(self, rows: DataFrame) -> np.ndarray:
        out = np.zeros(len(self.lists.centroids), dtype=np.int64)
        for r in rows.groupBy("list").count().collect():  # one row per list
            out[r["list"]] = r["count"]
        return out

    def visits(self, queries: DataFrame) -> DataFrame:
        """(near, list, id, variant, vec): the lists that queries visit; near is the nearest."""
        held, dim = self.held, self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column("vec"), dim)
                for start in range(0, len(x), 256):
                    row, at, near = held.value.visited(x[start : start + 256])
                    lists = np.split(at.astype(np.int32), np.cumsum(np.bincount(row, minlength=len(near)))[:-1])
                    part = batch.slice(start, 256)
                    yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(lists, pa.list_(pa.int32())), *(part.column(c) for c in ("id", "variant", "vec"))], names=["list", "visited", "id", "variant", "vec"])

        return queries.mapInArrow(run, "list int, visited array<int>, id long, variant int, vec array<double>")

    def search(self, is_query: Column) -> DataFrame:
        """(query_id, variant, rank, id, score) of the queries among the rows."""
        each = self.rows.where(F.coalesce(is_query, F.lit(False))).select("id", "vec").dropDuplicates(["id", "vec"])
        numbered = each.withColumn("variant", F.row_number().over(Window.partitionBy("id").orderBy("vec")) - 1)
        queries = cut(self.visits(numbered))
        first, parts, _ = pack(self.lists.sizes, BLOCK_ROWS)
        first_chunk, chunk_parts, _ = pack(self.counts(queries), QUERY_ROWS)
        spark, k, dim = self.rows.sparkSession, self.k, self.dim
        places = spark.createDataFrame([(i, *map(int, x)) for i, x in enumerate(zip(first, parts, first_chunk, chunk_parts))], "list int, first long, parts long, first_chunk long, chunk_parts long")
        places = F.broadcast(places)  # one row per list, at most MAX_LISTS
        blocks = self.posted.join(places, "list").select((F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts"))).alias("block"), "list", "id", "row", "vec")
        chunks = queries.join(places, "list").select((F.col("first_chunk") + F.pmod(F.xxhash64("id", "variant"), F.col("chunk_parts"))).alias("chunk"), "visited", "id", "variant", "vec")
        goes = chunks.select("chunk", F.explode("visited").alias("list")).distinct().join(places, "list")
        goes = goes.select("chunk", F.explode(F.expr("sequence(first, first + parts - 1)")).alias("block")).distinct()
        left = chunks.join(goes, "chunk")
        sent = goes.select(F.col("chunk").alias("to_chunk"), F.col("block").alias("to_block"))
        right = blocks.join(sent, F.col("block") == F.col("to_block")).select("block", F.col("to_chunk").alias("chunk"), "list", "id", "row", "vec")

        def score(q: pa.Table, x: pa.Table) -> pa.Table:
            names = ("query_id", "variant", "row", "id", "score")
            out = {n: [] for n in names}
            if q.num_rows and x.num_rows:
                rows, at, member = np.unique(x.column("row").to_numpy(), return_index=True, return_inverse=True)
                lists, local = np.unique(x.column("list").to_numpy(), return_inverse=True)
                vectors, ids = matrix(x.column("vec"), dim)[at], x.column("id").to_numpy()[at]
                held = np.zeros((len(rows), len(lists)), dtype=np.float32)
                held[member, local] = 1
                for part in q.to_batches(max_chunksize=256):
                    own, variant, wanted = part.column("id").to_numpy(), part.column("variant").to_numpy(), np.zeros((part.num_rows, len(lists)), dtype=np.float32)
                    for i, visited in enumerate(part.column("visited").to_pylist()):
                        wanted[i] = np.isin(lists, visited)
                    for i, near, found in _nearest(matrix(part.column("vec"), dim), own, vectors, ids, k, wanted @ held.T > 0):
                        for n, v in zip(names, (np.full(len(near), own[i]), np.full(len(near), variant[i]), rows[near], ids[near], found)):
                            out[n].append(v)
            kinds = (np.int64, np.int32, np.int64, np.int64, np.float64)
            return pa.table({n: np.concatenate(v).astype(t) if v else np.zeros(0, t) for (n, v), t in zip(out.items(), kinds)})

        met = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(score, "query_id long, variant int, row long, id long, score double")
        once = met.dropDuplicates(["query_id", "variant", "row"])  # a replicated row comes from several lists
        best = Window.partitionBy("query_id", "variant").orderBy("score", "id", "row")
        return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "variant", "rank", "id", "score")


def nearest(table: DataFrame, vec: Column, is_query: Column, vec_id: str, k: int = 10) -> DataFrame:
    """(query_id, variant, rank, id, score): for each query row the k nearest rows of other ids that are found.

    ``is_query`` is an expression over ``id``.
    """
    return Index(table, vec, vec_id, k).search(is_query)


def recall(found: DataFrame, true: DataFrame) -> float:
    """The share of the rows (query_id, id) of ``true`` that were found."""
    hits = true.select("query_id", "id").join(found.select("query_id", "id").distinct(), ["query_id", "id"], "left_semi").count()
    return hits / max(1, true.count())
