"""Exact top-k search in Hamming distance by incremental multi-index hashing.

Vectors become binary codes of their signs. Every task indexes the codes it holds by
each of their segments. For a query the search radius within the segments grows step by
step: after radius r every code within m * (r + 1) - 1 bits (m segments) has been seen,
as a code farther than r in all m segments is at least m * (r + 1) away. A query stops as
soon as its kth verified distance is below that, so the result is exact.

The queries are a stated set; they go to the tasks in blocks of ``BLOCK_QUERIES``. Each
task returns at most k rows per query, and the k nearest of all tasks remain.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_QUERIES = 50_000
SEGMENT_BITS = 16
INDEX_ROWS = 1 << 18
NEAREST = "query_id bigint, vec_id bigint, distance int"


def codes(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, bits): sign bits (1 for 0 and above) of vectors of ``dim`` values.

    Null vectors, vectors with a null or NaN and vectors of another length are left out.
    """
    lengths = pa.compute.list_value_length(vectors).fill_null(-1).to_numpy()
    rows = np.flatnonzero(lengths == dim)
    flat = vectors.take(pa.array(rows)).flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), dim)
    whole = ~np.isnan(values).any(axis=1)
    return rows[whole], (values[whole] >= 0).astype(np.uint8)


def _segments(bits: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """(value of each row, width) for each segment of up to SEGMENT_BITS bits."""
    dim = bits.shape[1]
    m = max(1, -(-dim // SEGMENT_BITS))
    cut = [dim * i // m for i in range(m + 1)]
    out = []
    for lo, hi in zip(cut[:-1], cut[1:]):
        out.append((bits[:, lo:hi].astype(np.int64) @ (1 << np.arange(hi - lo, dtype=np.int64)), hi - lo))
    return out


def _masks(width: int, radius: int) -> np.ndarray:
    """All values of ``width`` bits with ``radius`` bits set."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], np.int64)


class Index:
    """Codes by the values of their segments; equal codes share an entry."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray, k: int):
        packed = np.packbits(bits, axis=1)
        order = np.lexsort((ids, *packed.T[::-1]))
        again = np.zeros(len(ids), bool)
        again[1:] = (ids[order][1:] == ids[order][:-1]) & (packed[order][1:] == packed[order][:-1]).all(axis=1)
        order = order[~again]
        packed, ids = packed[order], ids[order]
        new = np.ones(len(ids), bool)
        new[1:] = (packed[1:] != packed[:-1]).any(axis=1)
        self.first = np.flatnonzero(new)
        self.last = np.append(self.first[1:], len(ids))
        self.ids, self.k = ids, k
        self.codes = packed[self.first]
        self.dim = bits.shape[1]
        self.tables = []
        for value, width in _segments(bits[order][self.first]):
            by = np.argsort(value, kind="stable")
            self.tables.append((value[by], by, width))

    def nearest(self, code: np.ndarray, parts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k nearest, ties by id."""
        m = len(self.tables)
        seen = np.zeros(len(self.codes), bool)
        found, dist, room = [], [], []
        for radius in range(max(w for _, _, w in self.tables) + 1):
            fresh = []
            for (values, by, width), part in zip(self.tables, parts):
                if radius > width:
                    continue
                probes = part ^ _cached_masks(width, radius)
                lo, hi = np.searchsorted(values, probes, "left"), np.searchsorted(values, probes, "right")
                hit = hi > lo
                fresh += [by[a:b] for a, b in zip(lo[hit], hi[hit])]
            if fresh:
                at = np.unique(np.concatenate(fresh))
                at = at[~seen[at]]
                seen[at] = True
                found.append(at)
                dist.append(np.bitwise_count(self.codes[at] ^ code).sum(axis=1))
                room.append(np.minimum(self.last[at] - self.first[at], self.k))
            if found:
                d, r = np.concatenate(dist), np.concatenate(room)
                order = np.argsort(d, kind="stable")
                held = np.cumsum(r[order])
                if held[-1] >= self.k:
                    kth = d[order][np.searchsorted(held, self.k)]
                    if kth < m * (radius + 1):
                        break
            if seen.all():
                break
        at, d = np.concatenate(found), np.concatenate(dist).astype(np.int64)
        order = np.argsort(d, kind="stable")
        held = np.cumsum(np.concatenate(room)[order])
        limit = d[order][min(np.searchsorted(held, self.k), len(order) - 1)]
        ids, far = [], []
        for i in np.flatnonzero(d <= limit):
            own = self.ids[self.first[at[i]] : min(self.last[at[i]], self.first[at[i]] + self.k)]
            ids.append(own)
            far.append(np.full(len(own), d[i]))
        ids, far = np.concatenate(ids), np.concatenate(far)
        best = np.lexsort((ids, far))[: self.k]
        return ids[best], far[best]


_mask_cache: dict[tuple[int, int], np.ndarray] = {}


def _cached_masks(width: int, radius: int) -> np.ndarray:
    key = (width, radius)
    if key not in _mask_cache:
        _mask_cache[key] = _masks(width, radius)
    return _mask_cache[key]


def _search(query_ids: np.ndarray, query_bits: np.ndarray, k: int):
    packed = np.packbits(query_bits, axis=1)
    parts = np.stack([v for v, _ in _segments(query_bits)], axis=1)

    def part_rows(ids: list[np.ndarray], bits: list[np.ndarray]) -> pa.RecordBatch:
        index = Index(np.concatenate(ids), np.concatenate(bits), k)
        rows = [index.nearest(packed[i], list(parts[i])) for i in range(len(query_ids))]
        sizes = [len(r[0]) for r in rows]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(query_ids, sizes)),
                pa.array(np.concatenate([r[0] for r in rows])),
                pa.array(np.concatenate([r[1] for r in rows]).astype(np.int32)),
            ],
            names=["query_id", "vec_id", "distance"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, bits, held = [], [], 0
        for batch in batches:
            rows, code = codes(batch.column("v"), query_bits.shape[1])
            ids.append(batch.column("id").to_numpy()[rows])
            bits.append(code)
            held += len(rows)
            if held >= INDEX_ROWS:
                yield part_rows(ids, bits)
                ids, bits, held = [], [], 0
        if held:
            yield part_rows(ids, bits)

    return run


def nearest_codes(
    vectors: DataFrame, queries: Column, k: int = 10, id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, distance): the k nearest other rows of each query row.

    ``queries`` is a condition that states the query rows; all rows are searched.
    Distances count differing sign bits; ties go by id, and a row is no neighbour of
    its own id. Rows with a null id, a null or empty vector, or a null inside are left
    out, and vectors of another length than most queries find nothing and are not found (of
    equally frequent lengths the smallest counts). Ids are
    taken to be unique: equal repeated rows count once, and a query whose id has two
    vectors searches with the smaller code. Fewer than k other rows give fewer.
    """
    rows = vectors.select(F.col(id).cast("bigint").alias("id"), F.col(vector).alias("v"), queries.alias("q"))
    rows = rows.where(F.col("id").isNotNull())
    asked = rows.where("q").select("id", "v")
    lengths = asked.where(F.size("v") > 0).groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.orderBy(F.desc("n"), "dim").first()
    n = asked.count() // BLOCK_QUERIES + 1 if most else 0
    out = None
    for i in range(n):
        block = asked.where(F.pmod(F.xxhash64("id"), F.lit(n)) == i).toArrow().combine_chunks()
        if not block.num_rows:
            continue
        found, bits = codes(block.column("v").combine_chunks(), most.dim)
        if not len(found):
            continue
        ids = block.column("id").to_numpy()[found]
        order = np.lexsort((*np.packbits(bits, axis=1).T[::-1], ids))
        ids, bits = ids[order], bits[order]
        once = np.append(True, ids[1:] != ids[:-1])
        # One more than asked for, as the row itself is found too.
        near = rows.select("id", "v").mapInArrow(_search(ids[once], bits[once], k + 1), NEAREST)
        out = near if out is None else out.unionByName(near)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], NEAREST)
    others = out.where(F.col("query_id") != F.col("vec_id")).distinct()
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    ranked = others.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "distance")
