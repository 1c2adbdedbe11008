"""Nearest neighbours by cosine through low-dimensional stable projections.

Unit vectors are projected by a fixed Gaussian matrix to ``PROJECTED`` dimensions. For two
of them at squared distance s, the squared distance of their projections divided by s
follows a chi-square law with so many degrees of freedom. Each task keeps its rows in
kd-trees of their projections. A query walks a tree in the order of projected distance and
verifies what it meets by the true cosine. It stops when a row at the kth distance found
so far would have been met already with the chance ``CONFIDENCE``: when the next projected
distance, over that kth distance, reaches that quantile of the law.

The queries are a stated set. They go to the tasks in blocks of bounded size; each task
returns k rows per query and tree, and the k nearest of all remain.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hashing import bound_batches

PROJECTED = 16
CONFIDENCE = 0.98
LEAF_ROWS = 512
BLOCK_BYTES = 32 << 20
TREE_BYTES = 64 << 20
# Cosines that differ by less are put in order by the exact measure.
SLACK = 1e-9
NEAREST = "query_id bigint, vec_id bigint, score double"


def chi_square(x: float, freedom: int) -> float:
    """The chance that a chi-square value with an even number of degrees is at most ``x``."""
    term = total = 1.0
    for i in range(1, freedom // 2):
        term *= x / (2 * i)
        total += term
    return 1.0 - math.exp(-x / 2) * total


def quantile(chance: float, freedom: int) -> float:
    """The value that a chi-square variable stays below with this chance."""
    low, high = 0.0, 1.0
    while chi_square(high, freedom) < chance:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, freedom) < chance else (low, mid)
    return high


def scaled(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, values): finite vectors of ``dim`` values that are not all zero.

    Each is scaled by a power of two, which changes no cosine and keeps squares in range.
    """
    lengths = pa.compute.list_value_length(vectors).fill_null(-1).to_numpy()
    rows = np.flatnonzero(lengths == dim)
    flat = vectors.take(pa.array(rows)).flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), dim)
    whole = np.isfinite(values).all(axis=1) & (values != 0).any(axis=1)
    values = values[whole]
    if len(values):
        _, power = np.frexp(np.abs(values).max(axis=1))
        values = np.ldexp(values, -power[:, None])
    return rows[whole], values


def norms(values: np.ndarray) -> np.ndarray:
    return np.sqrt((values * values).sum(axis=1))


def projection(dim: int) -> np.ndarray:
    return np.random.default_rng(20240713).standard_normal((dim, PROJECTED))


def few_of_each(ids: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """Rows to keep: of equal vectors those with the k + 1 smallest ids.

    No other can be among the k nearest of any query, as ties go by id; one more as the
    query's own row may be among them. Equal rows count once.
    """
    order = np.lexsort((ids, *values.T[::-1]))
    ids, values = ids[order], values[order]
    new = np.ones(len(ids), bool)
    new[1:] = (values[1:] != values[:-1]).any(axis=1)
    once = new.copy()
    once[1:] |= ids[1:] != ids[:-1]
    order, new = order[once], new[once]
    group = np.cumsum(new) - 1
    rank = np.arange(len(order)) - np.flatnonzero(new)[group]
    return order[rank <= k]


class Tree:
    """A kd-tree over projections: nodes hold a box, leaves a run of rows."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, matrix: np.ndarray):
        length = norms(values)
        unit = values / length[:, None]
        places = unit @ matrix
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.below: list[tuple[int, int]] = []
        self.run: list[tuple[int, int]] = []
        order = np.arange(len(ids))
        self._node(places, order, 0, len(order))
        self.ids, self.values, self.norms = ids[order], values[order], length[order]
        self.unit, self.places = unit[order], places[order]

    def _node(self, places: np.ndarray, order: np.ndarray, start: int, end: int) -> int:
        own = places[order[start:end]]
        me = len(self.run)
        low, high = own.min(axis=0), own.max(axis=0)
        self.low.append(low)
        self.high.append(high)
        self.below.append((-1, -1))
        self.run.append((start, end))
        axis = int((high - low).argmax())
        if end - start > LEAF_ROWS and high[axis] > low[axis]:
            half = (end - start) // 2
            order[start:end] = order[start:end][np.argpartition(own[:, axis], half)]
            left = self._node(places, order, start, start + half)
            self.below[me] = (left, self._node(places, order, start + half, end))
        return me

    def _distance(self, node: int, place: np.ndarray) -> float:
        gap = np.maximum(np.maximum(self.low[node] - place, place - self.high[node]), 0.0)
        return float(gap @ gap)

    def nearest(self, id: int, unit: np.ndarray, place: np.ndarray, k: int, reach: float, least: float):
        """(rows, kth cosine): verified rows that may be among the k nearest.

        ``reach`` is the quantile of the stopping test, ``least`` a cosine that k rows
        elsewhere have already.
        """
        rows = np.zeros(0, np.int64)
        cosines = np.zeros(0)
        frontier = [(self._distance(0, place), 0)]
        while frontier:
            far, node = heapq.heappop(frontier)
            # Unit vectors of cosine c are at squared distance 2 - 2c.
            stop = reach * (max(2.0 - 2.0 * least, 0.0) + SLACK)
            if far >= stop:
                break
            left, right = self.below[node]
            if left >= 0:
                heapq.heappush(frontier, (self._distance(left, place), left))
                heapq.heappush(frontier, (self._distance(right, place), right))
                continue
            start, end = self.run[node]
            gap = self.places[start:end] - place
            met = start + np.flatnonzero(((gap * gap).sum(axis=1) < stop) & (self.ids[start:end] != id))
            if not len(met):
                continue
            found = self.unit[met] @ unit
            close = found >= least - SLACK
            rows, cosines = np.append(rows, met[close]), np.append(cosines, found[close])
            if len(rows) >= k:
                least = max(least, float(np.partition(cosines, -k)[-k]))
                close = cosines >= least - SLACK
                rows, cosines = rows[close], cosines[close]
        return rows, least


def _search(query_ids: np.ndarray, queries: np.ndarray, k: int, confidence: float):
    dim = queries.shape[1]
    matrix = projection(dim)
    length = norms(queries)
    units = queries / length[:, None]
    places = units @ matrix
    reach = quantile(confidence, PROJECTED)

    def found_in(tree: Tree, least: np.ndarray) -> pa.RecordBatch:
        asked, ids, scores = [], [], []
        for i, id in enumerate(query_ids):
            rows, least[i] = tree.nearest(id, units[i], places[i], k, reach, least[i])
            if not len(rows):
                continue
            # The same sums for a pair wherever it is met, so equal vectors tie.
            exact = (tree.values[rows] * queries[i]).sum(axis=1) / (tree.norms[rows] * length[i])
            best = np.lexsort((tree.ids[rows], -exact))[:k]
            asked.append(np.full(len(best), id))
            ids.append(tree.ids[rows[best]])
            scores.append(exact[best])
        columns = [np.concatenate(c) if c else np.zeros(0) for c in (asked, ids, scores)]
        types = [np.int64, np.int64, np.float64]
        return pa.RecordBatch.from_arrays(
            [pa.array(c.astype(t)) for c, t in zip(columns, types)], names=["query_id", "vec_id", "score"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = max(LEAF_ROWS, TREE_BYTES // (8 * dim))
        least = np.full(len(query_ids), -2.0)
        ids, values, held = [], [], 0

        def tree() -> Tree:
            all_ids, all_values = np.concatenate(ids), np.concatenate(values)
            kept = few_of_each(all_ids, all_values, k)
            return Tree(all_ids[kept], all_values[kept], matrix)

        for batch in batches:
            rows, own = scaled(batch.column("v"), dim)
            ids.append(batch.column("id").to_numpy()[rows])
            values.append(own)
            held += len(rows)
            if held >= limit:
                yield found_in(tree(), least)
                ids, values, held = [], [], 0
        if held:
            yield found_in(tree(), least)

    return run


def nearest_cosine(
    vectors: DataFrame,
    queries: Column,
    k: int = 5,
    id: str = "vec_id",
    vector: str = "embedding",
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k nearest other rows found.

    ``queries`` is a condition that states the query rows; all rows are indexed. ``score``
    is the cosine in double precision; ties go by the smaller id. Vectors that are null,
    empty, all zero or hold a null or a value that is not finite take no part, nor do rows
    with a null id or vectors of another length than most queries (of equally frequent
    lengths the smallest counts). Equal rows count once; of a query id with several
    vectors the smallest searches, and rows of the query's own id are no candidates. Fewer
    candidates than k give fewer rows, an empty table gives none. Other columns are
    ignored. Each true neighbour is found with a chance of at least ``confidence`` or so.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = vectors.select(F.col(id).cast("bigint").alias("id"), F.col(vector).alias("v"), queries.alias("q"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull())
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    asked = rows.where(F.col("q") & finite & F.exists("v", lambda x: x != 0)).select("id", "v")
    lengths = asked.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.orderBy(F.desc("n"), "dim").first()
    out = None
    if most:
        # One row per query id, so a block is bounded however often an id repeats.
        asked = asked.where(F.size("v") == most.dim).groupBy("id").agg(F.min("v").alias("v"))
        n = asked.count() * 8 * most.dim // BLOCK_BYTES + 1
        for i in range(n):
            block = asked.where(F.pmod(F.xxhash64("id"), F.lit(n)) == i).orderBy("id").toArrow()
            if not block.num_rows:
                continue
            _, values = scaled(block.column("v").combine_chunks(), most.dim)
            found = rows.select("id", "v").mapInArrow(
                _search(block.column("id").to_numpy(), values, k, confidence), NEAREST
            )
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], NEAREST)
    once = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
