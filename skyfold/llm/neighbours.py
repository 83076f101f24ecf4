"""Nearest neighbours by an inverted multi-index.

Both halves of the vectors are quantised on their own; a pair of centroids is a cell.
A query walks the cells by the sum of its two distances, nearest first, with a heap
(the multi-sequence walk), until the cells seen hold a set share of all vectors.
Cells and the queries that visit them meet in one task each, a large cell in several,
and their vectors are ranked by the exact distance.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyfold.llm.common import slices

#: Centroids of each half; the index has their square as cells.
CENTROIDS = 32
#: Vectors that the centroids are fitted on, at most.
SAMPLE = 8_192
#: Share of the indexed vectors that a query's cells hold together, and the least number.
COVERAGE = 0.55
LEAST = 256
#: Vectors of a cell that one task gets.
PART = 2_048
NEAREST = 10


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` (doubles) of the rows that take part, repeated rows once.

    Left out: null ids or vectors, vectors that are empty, all zero, or hold a null
    or non-finite component.
    """
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)).dropDuplicates(["vec_id", "embedding"])


def distinct_vectors(rows: DataFrame, keep: int = NEAREST + 1) -> DataFrame:
    """``embedding, ids``: each distinct vector with its smallest ids.

    A query needs no more than ``keep`` of equally near rows. The limit is applied in
    each task before the shuffle, so a vector that many rows share stays small.
    """
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id")))
    return ranked.where(F.col("place") <= keep).groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def kmeans(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's centroids from evenly spaced starts of the sorted sample; fewer points than ``k`` are their own."""
    if len(points) <= k:
        return points.copy()
    order = np.lexsort(points.T[::-1])
    centres = points[order[np.linspace(0, len(points) - 1, k).astype(int)]].copy()
    for _ in range(rounds):
        near = _squares(points, centres).argmin(1)
        for c in np.unique(near):
            centres[c] = points[near == c].mean(0)
    return centres


def _squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances; without the points' own norms, which change no order, they would not add up over halves."""
    return (points**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * points @ centres.T


class Index:
    """Centroids of both halves."""

    def __init__(self, sample: np.ndarray, k: int = CENTROIDS):
        self.dimension = sample.shape[1]
        self.half = self.dimension // 2
        self.first, self.second = kmeans(sample[:, : self.half], k), kmeans(sample[:, self.half :], k)

    def distances(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _squares(points[:, : self.half], self.first), _squares(points[:, self.half :], self.second)

    def cells(self, points: np.ndarray) -> np.ndarray:
        a, b = self.distances(points)
        return a.argmin(1) * len(self.second) + b.argmin(1)

    def walk(self, a: np.ndarray, b: np.ndarray, held: np.ndarray, wanted: int) -> list[int]:
        """Cells in the order of the summed distance until they hold ``wanted`` vectors; empty cells are passed by."""
        order_a, order_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        heap = [(float(a[order_a[0]] + b[order_b[0]]), 0, 0)]
        done = np.zeros(len(a), np.int64)  # of each row, how many columns came out
        found, total = [], 0
        while heap and total < wanted:
            _, i, j = heapq.heappop(heap)
            done[i] = j + 1
            cell = int(order_a[i]) * len(b) + int(order_b[j])
            if held[cell]:
                found.append(cell)
                total += int(held[cell])
            # a neighbour enters once both its own smaller neighbours came out
            if j + 1 < len(b) and (i == 0 or done[i - 1] > j + 1):
                heapq.heappush(heap, (float(a[order_a[i]] + b[order_b[j + 1]]), i, j + 1))
            if i + 1 < len(a) and done[i + 1] == j:
                heapq.heappush(heap, (float(a[order_a[i + 1]] + b[order_b[j]]), i + 1, j))
        return found


def _matrix(column: pa.Array | pa.ChunkedArray, dimension: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), dimension).astype(np.float64)


def _ranked(cell: pa.Table, queries: pa.Table, dimension: int, nearest: int) -> pa.Table:
    """For each query the nearest rows of one part of a cell, as packed ids and distances."""
    vectors, asked = _matrix(cell["embedding"], dimension), _matrix(queries["embedding"], dimension)
    ids = cell["ids"].to_pylist()
    out_ids, out_scores = [], []
    for q, own in zip(asked, queries["query_id"].to_pylist(), strict=True):
        distance = np.sqrt(((vectors - q) ** 2).sum(1))
        reach = len(distance) if len(distance) <= nearest + 1 else nearest + 1
        bound = np.partition(distance, reach - 1)[reach - 1]
        best = sorted((float(distance[k]), v) for k in np.flatnonzero(distance <= bound) for v in ids[k] if v != own)[:nearest]
        out_ids.append(np.array([v for _, v in best], "<i8").tobytes())
        out_scores.append(np.array([s for s, _ in best], "<f8").tobytes())
    return pa.table({"query_id": queries["query_id"], "ids": pa.array(out_ids, pa.binary()), "scores": pa.array(out_scores, pa.binary())})


def search(vectors: DataFrame, queries: DataFrame, nearest: int = NEAREST, coverage: float = COVERAGE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest found rows of each query, its own row left out.

    ``queries`` holds ``vec_id, embedding`` like ``vectors``; rows that take no part
    (see :func:`usable`) and, where lengths differ, vectors of another length than the
    sample's commonest are neither candidates nor queries. Ties go to the smaller id.
    Every vector is indexed; the centroids alone come from a bounded sample, and what
    the driver holds besides is one count for each cell.
    """
    out = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors)
    drawn = rows.select("embedding").orderBy(F.xxhash64("embedding"), "vec_id").limit(SAMPLE).collect()
    if not drawn:
        return vectors.sparkSession.createDataFrame([], out)
    lengths = [len(r["embedding"]) for r in drawn]
    dimension = max(set(lengths), key=lambda n: (lengths.count(n), n))
    index = Index(np.array([r["embedding"] for r in drawn if len(r["embedding"]) == dimension]))
    n_cells = len(index.first) * len(index.second)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1024):
            cells = index.cells(_matrix(part.column(0), dimension))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells, pa.int64())], ["embedding", "ids", "cell"])

    fitting = F.size("embedding") == dimension
    placed = distinct_vectors(rows.where(fitting), nearest + 1).mapInArrow(place, "embedding array<double>, ids array<long>, cell long")
    held = np.zeros(n_cells, np.int64)
    for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect():  # one row a cell at most
        held[r["cell"]] = r["n"]
    wanted = max(LEAST, math.ceil(coverage * int(held.sum())))
    parts = np.maximum(1, -(-held // PART))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 16):
            points = _matrix(part.column(1), dimension)
            take, cell, piece = [], [], []
            for k, (a, b) in enumerate(zip(*index.distances(points), strict=True)):
                for c in index.walk(a, b, held, wanted):
                    for p in range(int(parts[c])):
                        take.append(k)
                        cell.append(c)
                        piece.append(p)
            chosen = part.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array(cell, pa.int64()), pa.array(piece, pa.int64())], ["query_id", "embedding", "cell", "part"])

    asked = usable(queries).where(fitting).select(F.col("vec_id").alias("query_id"), "embedding")
    visits = asked.mapInArrow(walk, "query_id long, embedding array<double>, cell long, part long")
    sizes = F.array(*(F.lit(int(p)) for p in parts))
    entries = placed.withColumn("part", F.pmod(F.xxhash64("embedding"), F.get(sizes, F.col("cell").cast("int")).cast("long")))

    def rank(cell: pa.Table, some: pa.Table) -> pa.Table:
        if not (cell.num_rows and some.num_rows):
            return pa.table({"query_id": pa.array([], pa.int64()), "ids": pa.array([], pa.binary()), "scores": pa.array([], pa.binary())})
        return _ranked(cell, some, dimension, nearest)

    found = entries.groupBy("cell", "part").cogroup(visits.groupBy("cell", "part")).applyInArrow(rank, "query_id long, ids binary, scores binary")

    def merge(group: pa.Table) -> pa.Table:
        pairs = [
            (s, v)
            for ids, scores in zip(group["ids"].to_pylist(), group["scores"].to_pylist(), strict=True)
            for s, v in zip(np.frombuffer(scores, "<f8").tolist(), np.frombuffer(ids, "<i8").tolist(), strict=True)
        ]
        best = heapq.nsmallest(nearest, pairs)
        query = group["query_id"][0].as_py()
        return pa.table(
            {
                "query_id": pa.array([query] * len(best), pa.int64()), "rank": pa.array(range(1, len(best) + 1), pa.int32()),
                "vec_id": pa.array([v for _, v in best], pa.int64()), "score": pa.array([s for s, _ in best], pa.float64()),
            }
        )

    return found.groupBy("query_id").applyInArrow(merge, out)
