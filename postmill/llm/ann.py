"""Nearest neighbours by stable projections to few dimensions and kd-trees over them.

Vectors are dealt into shards; a shard projects its vectors on a few Gaussian (2-stable) directions
and indexes all of them in a kd-tree. For a query the tree gives projected neighbours in order of
projected distance, and each is verified by its exact distance, until a chi-square test says that a
vector nearer than the k-th best would have shown up: a squared projected distance over the true one
is chi-square distributed with as many degrees of freedom as there are directions.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Directions (even; never more than a vector has components), confidence of the test, vectors in a leaf and in a shard. More directions tell near from far
#: better; the confidence is about the share of true neighbours that the test lets through.
DIRECTIONS, CONFIDENCE, LEAF, SHARD = 32, 0.95, 64, 8192


def chi_square(x: float, freedom: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    term = total = 1.0
    for i in range(1, freedom // 2):
        term *= x / 2 / i
        total += term
    return 1.0 - math.exp(-x / 2) * total


def chi_square_at(p: float, freedom: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, freedom) < p else (low, mid)
    return high


class Tree:
    """A kd-tree over rows of ``points``: cells split at the median of their widest direction down
    to leaves of ``LEAF`` rows, with the box of what each holds."""

    def __init__(self, points: np.ndarray):
        self.points, self.rows = points, np.arange(len(points))
        self.cells: list[tuple] = []  # low, high, children or (start, end)
        self._grow(0, len(points))

    def _grow(self, a: int, b: int) -> int:
        own = self.points[self.rows[a:b]]
        low, high = own.min(axis=0), own.max(axis=0)
        at = len(self.cells)
        self.cells.append(())
        if b - a <= LEAF or not (high > low).any():
            self.cells[at] = (low, high, None, (a, b))
            return at
        middle = (b - a) // 2
        axis = int(np.argmax(high - low))
        self.rows[a:b] = self.rows[a:b][np.argpartition(own[:, axis], middle)]
        left = self._grow(a, a + middle)
        self.cells[at] = (low, high, (left, self._grow(a + middle, b)), None)
        return at

    def leaves(self, q: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """Leaves' rows by the squared projected distance from ``q`` to their box."""

        def far(cell: int) -> float:
            low, high = self.cells[cell][:2]
            gap = np.maximum(np.maximum(low - q, q - high), 0)
            return float(gap @ gap)

        heap = [(far(0), 0)]
        while heap:
            d, cell = heapq.heappop(heap)
            children, span = self.cells[cell][2:]
            if children is None:
                yield d, self.rows[span[0] : span[1]]
            else:
                for c in children:
                    heapq.heappush(heap, (far(c), c))


class Shard:
    """The vectors of a shard, projected and indexed once."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, directions: int, seed: int, confidence: float = CONFIDENCE):
        directions = min(directions, max(2, vectors.shape[1] // 2 * 2))
        self.limit = chi_square_at(confidence, directions)
        self.project = np.random.default_rng(seed).standard_normal((vectors.shape[1], directions))
        self.ids, self.vectors, self.tree = ids, vectors, Tree(vectors @ self.project)
        self.verified = 0

    def nearest(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(vectors, distances) of the query's ``k`` nearest found."""
        best_d, best_i, place = np.zeros(0), np.zeros(0, np.int64), q @ self.project
        for bound, rows in self.tree.leaves(place):
            # Stop when a vector as near as the k-th best would have had a smaller projection, with the
            # confidence asked for; at distance 0 only a projection of 0 can tie. Within a leaf the same test
            # holds for each vector.
            if len(best_d) == k:
                most = self.limit * best_d[-1] ** 2 * (1 + 1e-12)
                if bound > most:
                    break
                rows = rows[((self.tree.points[rows] - place) ** 2).sum(axis=1) <= most]
            self.verified += len(rows)
            diff = self.vectors[rows] - q
            d = np.sqrt(np.einsum("ij,ij->i", diff, diff))
            ok = self.ids[rows] != query_id
            if len(best_d) == k:
                ok &= d <= best_d[-1]
            best_d, best_i = np.concatenate([best_d, d[ok]]), np.concatenate([best_i, self.ids[rows][ok]])
            top = np.lexsort((best_i, best_d))[:k]
            best_d, best_i = best_d[top], best_i[top]
        return best_i, best_d


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, not all zeros, all components finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(finite(x), F.lit(False))) & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, queries: Column, k: int = 10, directions: int = DIRECTIONS, confidence: float = CONFIDENCE, seed: int = 17) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each row of ``vectors`` (vec_id, embedding) with the
    condition ``queries`` its ``k`` nearest other vectors found, by Euclidean distance in double
    precision, ties to the smaller vec_id; fewer if there are fewer.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
    rows without a vec_id; vectors of different lengths are not compared. Repeated rows of a vec_id
    count as one; of different vectors of one vec_id the first in order counts. All vectors are indexed:
    each is shuffled once, to its shard of about ``SHARD``, which a task indexes once; then the queries, of which
    every shard gets all, stream past it. Other columns are ignored."""
    rows = vectors.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    rows = rows.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    shards = max(1, -(-rows.count() // SHARD))
    shard = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).cast("int")
    data = rows.select(shard.alias("shard"), F.size("v").alias("dim"), F.lit(0).alias("role"), "vec_id", "v")
    asked = rows.filter(queries).groupBy("vec_id", F.size("v").alias("dim")).agg(F.min("v").alias("v"))
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "dim", F.lit(1).alias("role"), "vec_id", "v")
    dealt = data.union(asked).repartition("shard").sortWithinPartitions("shard", "dim", "role", "vec_id", "v")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, parts, held = None, [], None
        for batch in batches:
            ends = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:3]])
            cuts = np.append(np.flatnonzero(np.append(True, (ends[:, 1:] != ends[:, :-1]).any(axis=0))), batch.num_rows)
            found: list[tuple] = []
            for a, b in zip(cuts, cuts[1:]):
                here, role = (int(ends[0, a]), int(ends[1, a])), int(ends[2, a])
                if here != place:
                    place, parts, held = here, [], None
                part = batch.slice(a, b - a)
                ids, v = part.column(3).to_numpy(), part.column(4).flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)
                if role == 0:
                    parts.append((ids, v))
                    continue
                if held is None and parts:
                    every, v_every = (np.concatenate(x) for x in zip(*parts))
                    first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
                    held, parts = Shard(every[first], v_every[first], directions, seed, confidence), []
                if held is not None:
                    for query, q in zip(ids.tolist(), v):
                        found.append((query, *held.nearest(query, q, k)))
            n = [len(f[1]) for f in found]
            vec, score = (np.concatenate([f[j] for f in found]) if found else np.zeros(0, t) for j, t in ((1, np.int64), (2, float)))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([f[0] for f in found], np.int64), n)), pa.array(vec.astype(np.int64)), pa.array(score)], ["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
