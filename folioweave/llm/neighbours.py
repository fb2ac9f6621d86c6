"""Approximate nearest neighbours (largest inner product) over an inverted multi-index.

The two halves of a vector are quantised apart, with centroids fitted on a bounded sample; the pair of centroids is the
cell. Equal vectors are one entry with its smallest ids. For a query, cells are visited in the order of the summed inner
products of its halves with the cell's two centroids, taken from a heap over the two sorted lists, until the cells hold
``share`` of all entries; share is the smallest that reached ``AIM`` recall for sampled queries against the sample by brute
force, so clustered data visit few cells and shapeless data many. Entries are then reranked by the exact product. The number
of centroids follows the number of vectors: about ``CELL`` entries a cell, up to ``CENTROIDS`` a half.

Entries are laid out in shards of at most ``SHARD`` entries: whole cells while they fit, a large cell over several shards.
Queries go to the shards that hold their cells; a shard's entries are held in memory, its queries stream past them. Only
centroids, cell counts and the sample reach the driver, all of fixed size; every vector is indexed.

Defined results: null vectors, zero vectors, vectors holding null or non-finite components, vectors of another dimension
than the sample's, and null ids take no part; fewer candidates than k give fewer rows; ties go to the smaller vec_id; rows
that share an id are one entry and one query, with the smallest of their usable vectors; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Rows of the sample (more for many centroids), most centroids of a half, entries a cell, rounds of fitting, recall to aim for
#: in the sample, entries of a shard, queries at once.
SAMPLE, CENTROIDS, CELL, ROUNDS, AIM, SHARD, QUERIES = 10_000, 1024, 8, 12, 0.95, 8192, 512


def fit_half(points: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """Centroids by Lloyd's rounds from distinct starting points."""
    distinct = np.unique(points, axis=0)
    rng = np.random.default_rng(seed)
    centres = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        of = nearest(points, centres)
        counts = np.bincount(of, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, of, points)
        some = counts > 0
        centres[some] = sums[some] / counts[some, None]
    return centres


def nearest(points: np.ndarray, centres: np.ndarray, rows: int = 4096) -> np.ndarray:
    norms = (centres**2).sum(1)
    return np.concatenate([np.argmin(norms - 2 * points[a : a + rows] @ centres.T, axis=1) for a in range(0, len(points), rows)] or [np.zeros(0, np.int64)])


def centroids_for(n: int) -> int:
    """Centroids of a half for n vectors."""
    return int(min(CENTROIDS, max(4, round((n / CELL) ** 0.5))))


def traverse(first: np.ndarray, second: np.ndarray, counts: np.ndarray, budget: float) -> list[int]:
    """Cells (pairs of centroids) by summed score, best first, until they hold ``budget`` entries; empty cells are skipped."""
    a, b = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
    x, y, n = first[a].tolist(), second[b].tolist(), len(second)
    heap, seen, out, held = [(-(x[0] + y[0]), 0, 0)], {(0, 0)}, [], 0
    while heap and held < budget:
        _, i, j = heapq.heappop(heap)
        cell = a[i] * n + b[j]
        if counts[cell]:
            out.append(cell)
            held += int(counts[cell])
        for i2, j2 in ((i + 1, j), (i, j + 1)):
            if i2 < len(a) and j2 < n and (i2, j2) not in seen:
                seen.add((i2, j2))
                heapq.heappush(heap, (-(x[i2] + y[j2]), i2, j2))
    return out


class MultiIndex:
    """Centroids of both halves, and the share of entries that a query visits."""

    def __init__(self, sample: np.ndarray, centroids: int = CENTROIDS, aim: float = AIM, k: int = 20):
        self.dim, self.half = sample.shape[1], (sample.shape[1] + 1) // 2
        self.first, self.second = fit_half(sample[:, : self.half], centroids), fit_half(sample[:, self.half :], centroids)
        self.share = self.calibrate(sample, aim, k)

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        return nearest(vectors[:, : self.half], self.first) * len(self.second) + nearest(vectors[:, self.half :], self.second)

    def visit(self, query: np.ndarray, counts: np.ndarray, budget: float) -> list[int]:
        return traverse(self.first @ query[: self.half], self.second @ query[self.half :], counts, budget)

    def calibrate(self, sample: np.ndarray, aim: float, k: int, queries: int = 100) -> float:
        """Share of the sample to visit so that ``aim`` of true neighbours are in it."""
        cells = self.cells(sample)
        counts = np.bincount(cells, minlength=len(self.first) * len(self.second))
        needed = []
        for q in range(0, len(sample), max(1, len(sample) // queries)):
            scores = sample @ sample[q]
            scores[q] = -np.inf
            best = np.argsort(-scores)[: min(k, len(sample) - 1)]
            order = self.visit(sample[q], counts, float("inf"))
            upto = dict(zip(order, np.cumsum(counts[order]).tolist(), strict=True))
            needed += [upto[c] / len(sample) for c in cells[best].tolist()]
        return min(1.0, float(np.quantile(needed, aim)) * 1.02 + 0.01) if needed else 1.0


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (doubles) of the vectors that take part."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    found = common.only(vectors, id_col, vector_col).toDF("vec_id", "v").withColumn("v", v.cast("array<double>"))
    found = found.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0.0))
    if found.groupBy("vec_id").count().where("count > 1").isEmpty():
        return found
    return found.groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def entries(vectors: DataFrame, index: MultiIndex, keep: int) -> DataFrame:
    """cell, vector (bytes), ids (the smallest ``keep``) of each distinct vector; equals are merged in each batch first."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m, ids = matrix(batch.column(1)) + 0.0, batch.column(0).to_numpy()
            raw = np.ascontiguousarray(m).view(np.dtype((np.void, m.shape[1] * 8))).ravel()
            order = np.lexsort((ids,))
            _, start, of = np.unique(raw[order], return_index=True, return_inverse=True)
            grouped = np.argsort(of, kind="stable")
            cuts = np.cumsum(np.bincount(of))[:-1]
            lists = [x[:keep] for x in np.split(ids[order][grouped], cuts)]
            rows = order[start]
            yield pa.RecordBatch.from_arrays([pa.array(index.cells(m[rows]), pa.int32()), pa.array([raw[r].tobytes() for r in rows], pa.binary()), pa.array(lists, pa.list_(pa.int64()))], names=["cell", "vector", "ids"])

    coded = common.arrow(vectors, code, "cell int, vector binary, ids array<bigint>")
    return coded.groupBy("cell", "vector").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, keep).alias("ids"))


def layout(counts: np.ndarray, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """First shard and number of shards of each cell: small cells share one, a large one is spread over several."""
    first, many = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    at, held = 0, 0
    for cell, n in enumerate(counts.tolist()):
        if n > shard:
            at, held = at + (held > 0), 0
            first[cell], many[cell] = at, -(-n // (shard // 2))
            at += many[cell]
        else:
            if held + n > shard:
                at, held = at + 1, 0
            first[cell] = at
            held += n
    return first, many


def nearest_neighbours(vectors: DataFrame, queries: DataFrame | None = None, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, sample_rows: int = SAMPLE, centroids: int | None = None, aim: float = AIM, shard: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for each query (rows of vectors with ids divisible by every,
    unless queries are given)."""
    spark = vectors.sparkSession
    common.tune(spark)
    vectors = usable(vectors, id_col, vector_col)
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    n = vectors.count()
    centroids = centroids or centroids_for(n)
    sample_rows = max(sample_rows, 16 * centroids)
    shard = shard or min(SHARD, max(256, n // (2 * spark.sparkContext.defaultParallelism)))  # small tables too fill all cores
    thin = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, 1.5 * sample_rows / max(1, n))))
    rows = thin.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("v").collect() or vectors.limit(sample_rows).select("v").collect()
    if not rows:
        return spark.createDataFrame([], schema)
    sizes = np.array([len(r.v) for r in rows])
    dim = int(np.bincount(sizes).argmax())  # of equally frequent ones the smallest
    vectors = vectors.where(F.size("v") == dim)
    asked = usable(queries, id_col, vector_col).where(F.size("v") == dim) if queries is not None else vectors.where(F.col("vec_id") % every == 0)
    index = MultiIndex(np.array([r.v for r in rows if len(r.v) == dim]), centroids, aim, k)
    stored = common.written(entries(vectors, index, k + 1), "neighbours")
    counts = np.zeros(len(index.first) * len(index.second), np.int64)
    for r in stored.groupBy("cell").count().collect():
        counts[r["cell"]] = r["count"]
    first, many = layout(counts, shard)
    shared = spark.sparkContext.broadcast((index, counts, first, many))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, first, many = shared.value
        for batch in batches:
            cells = batch.column(0).to_numpy()
            spread = np.array([zlib.crc32(v) for v in batch.column(1).to_pylist()], np.int64) % many[cells]
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(first[cells] + spread), pa.array(np.zeros(len(cells), np.int32)), none, batch.column(1), pa.array([[c] for c in cells], pa.list_(pa.int32())), batch.column(2)], names=names)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, counts, first, many = shared.value
        budget = index.share * counts.sum()
        for batch in batches:
            for query, v in zip(batch.column(0).to_pylist(), matrix(batch.column(1)), strict=True):
                by_shard: dict[int, list[int]] = {}
                for cell in index.visit(v, counts, budget):
                    for s in range(int(first[cell]), int(first[cell] + many[cell])):
                        by_shard.setdefault(s, []).append(cell)
                m = len(by_shard)
                yield pa.RecordBatch.from_arrays([pa.array(list(by_shard), pa.int64()), pa.array([1] * m, pa.int32()), pa.array([query] * m, pa.int64()), pa.array([v.tobytes()] * m, pa.binary()), pa.array(list(by_shard.values()), pa.list_(pa.int32())), pa.array([[]] * m, pa.list_(pa.int64()))], names=names)

    names = ["shard", "kind", "query_id", "vector", "cells", "ids"]
    kinds = "shard bigint, kind int, query_id bigint, vector binary, cells array<int>, ids array<bigint>"

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"shard": None}

        def add(batch: pa.RecordBatch, shard: int) -> None:
            if state["shard"] != shard:
                state.update(shard=shard, m=[], cells=[], ids=[], ready=None)
            state["m"].append(np.frombuffer(b"".join(batch.column(3).to_pylist()), np.float64).reshape(batch.num_rows, -1))
            state["cells"].append(batch.column(4).flatten().to_numpy())
            state["ids"] += batch.column(5).to_pylist()

        def best(batch: pa.RecordBatch, shard: int) -> pa.RecordBatch | None:
            if state["shard"] != shard:
                return None
            if state["ready"] is None:
                cells = np.concatenate(state["cells"])
                state["ready"] = np.concatenate(state["m"]), cells, np.unique(cells)
            m, cells, known = state["ready"]
            asks, visited = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.float64).reshape(batch.num_rows, -1), batch.column(4).to_pylist()
            scores = asks @ m.T
            of = np.searchsorted(known, cells)
            out: list[tuple] = []
            for i, query in enumerate(batch.column(2).to_pylist()):
                open_cells = np.isin(known, visited[i])
                row = np.where(open_cells[of], scores[i], -np.inf)
                some = min(len(row), k + 9)
                top = np.argpartition(-row, some - 1)[:some]
                top = top[row[top] > -np.inf]
                exact = (m[top] * asks[i]).sum(axis=1)
                found = [(-s, v) for s, t in zip(exact.tolist(), top.tolist(), strict=True) for v in state["ids"][t] if v != query]
                out += [(query, v, -s) for s, v in heapq.nsmallest(k, found)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.float64())], names=["query_id", "vec_id", "score"])

        for batch in batches:
            shards, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(shards) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(shards)], strict=True):
                for c in range(a, b, QUERIES):
                    part = batch.slice(c, min(b, c + QUERIES) - c)
                    if kind[a] == 0:
                        add(part, int(shards[a]))
                    elif (done := best(part, int(shards[a]))) is not None:
                        yield done

    laid = common.arrow(stored, place, kinds).unionByName(common.arrow(asked, ask, kinds))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(int(first.max() + many.max()), 100_000))
    found = common.arrow(laid.repartition(parts, "shard").sortWithinPartitions("shard", "kind"), rerank, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
