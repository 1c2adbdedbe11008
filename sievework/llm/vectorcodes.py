"""Codes of vectors by integer k-means over Hilbert-sorted flat blocks.

Vectors become integers and are cut into equal parts. The parts of each position are put
in the order of a Hilbert curve and stored in flat blocks with their smallest box, their
sum and their number; that table is written once. In every round the distances from a box
to the codebook's entries leave a short list of entries that can be nearest to any point
in it: an entry is out when its least distance to the box is above the greatest distance
of some other entry. A block with one entry on its list is assigned by its sum without
being opened; the others are evaluated exactly in integers. Tasks send one sum per entry,
the driver holds the codebooks alone, and floors go down.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..plans.scale import small_side, stage
from .hashing import bound_batches

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
BLOCK_ROWS = 256
# Bits of a Hilbert key: it only puts neighbours in the same block.
KEY_BITS, CELL_BITS = 128, 8
# Integer-valued doubles are exact below this.
EXACT = 1 << 53

BLOCKS = (
    "part int, n int, low binary, high binary, total binary, points binary, "
    "rows array<bigint>, ids array<bigint>, labels array<{label}>"
)


def component_limit(dim: int) -> int:
    """The largest integer component: squared distances of ``dim`` of them fit a long."""
    return 1 << ((61 - (dim - 1).bit_length()) // 2)


def integers(vectors: pa.Array, dim: int) -> np.ndarray:
    """floor(SCALE * x) of vectors of ``dim`` finite values, within the component limit."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    limit = component_limit(dim)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values * SCALE), -limit, limit).astype(np.int64)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along a Hilbert curve of points with ``bits``-bit coordinates, as bytes.

    Works on all points at once, one coordinate and bit at a time: undo the rotations
    from the top bit down, then Gray-code, then interleave the bits.
    """
    axes = [c.astype(np.int64) for c in cells.T]
    for bit in range(bits - 1, 0, -1):
        top, below = 1 << bit, (1 << bit) - 1
        for axis in range(len(axes)):
            flip = (axes[axis] & top) != 0
            swap = np.where(flip, 0, (axes[0] ^ axes[axis]) & below)
            axes[0] = np.where(flip, axes[0] ^ below, axes[0] ^ swap)
            axes[axis] = axes[axis] ^ swap if axis else axes[0]
    for axis in range(1, len(axes)):
        axes[axis] ^= axes[axis - 1]
    turn = np.zeros(len(cells), np.int64)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((axes[-1] & (1 << bit)) != 0, (1 << bit) - 1, 0)
    planes = [((a ^ turn) >> bit) & 1 for bit in range(bits - 1, -1, -1) for a in axes]
    return np.packbits(np.stack(planes, axis=1).astype(np.uint8), axis=1)


def _binary(rows: np.ndarray) -> pa.Array:
    """One binary value per row of a two-dimensional array."""
    rows = np.ascontiguousarray(rows)
    n, width = len(rows), rows.shape[1] * rows.itemsize if rows.ndim > 1 else 0
    offsets = np.arange(n + 1, dtype=np.int64) * width
    data = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())]
    )
    return data.cast(pa.binary())


def _numbers(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    """Binary values of ``width`` numbers each as one array."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def _points(dim: int, seeds: list[np.ndarray]):
    """Each vector as one row per part: its integers, its Hilbert key and what it belongs to."""
    width = dim // PARTS
    axes = min(width, KEY_BITS)
    bits = max(1, min(CELL_BITS, KEY_BITS // axes))
    low = [s.min(axis=0)[:axes] for s in seeds]
    span = [s.max(axis=0)[:axes] - at + 1 for s, at in zip(seeds, low)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = integers(batch.column("v"), dim)
            rows, ids, labels = (batch.column(c) for c in ("row", "vec_id", "label"))
            for part in range(PARTS):
                own = whole[:, part * width : (part + 1) * width]
                cells = np.clip(((own[:, :axes] - low[part]) << bits) // span[part], 0, (1 << bits) - 1)
                # Ids and labels travel with the first part only.
                first = part == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(own), part, np.int32)),
                        _binary(hilbert_keys(cells, bits)),
                        rows,
                        ids if first else pa.nulls(len(own), ids.type),
                        labels if first else pa.nulls(len(own), labels.type),
                        _binary(own.astype(np.int32)),
                    ],
                    names=["part", "key", "row", "vec_id", "label", "point"],
                )

    return run


def _blocks(width: int):
    """Sorted rows as flat blocks of one part each."""

    def block(part: int, rows: pa.Table) -> list:
        points = _numbers(rows.column("point"), "<i4", width)
        wide = points.astype(np.int64)
        return [
            part,
            len(points),
            wide.min(axis=0).tobytes(),
            wide.max(axis=0).tobytes(),
            wide.sum(axis=0).tobytes(),
            points.tobytes(),
            rows.column("row").combine_chunks(),
            rows.column("vec_id").combine_chunks(),
            rows.column("label").combine_chunks(),
        ]

    def written(blocks: list[list], label: pa.DataType) -> pa.RecordBatch:
        flat = [pa.array([b[i] for b in blocks], t) for i, t in enumerate([pa.int32(), pa.int32()] + [pa.binary()] * 4)]
        ends = pa.array(np.cumsum([0] + [b[1] for b in blocks]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.concat_arrays([b[i] for b in blocks])) for i in (6, 7, 8)]
        names = ["part", "n", "low", "high", "total", "points", "rows", "ids", "labels"]
        return pa.RecordBatch.from_arrays(flat + lists, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if held is None else pa.concat_tables([held, now])
            parts = now.column("part").to_numpy()
            cuts = np.append(np.flatnonzero(np.diff(parts)) + 1, len(parts))
            done, start = [], 0
            for end in cuts:
                last = end == len(parts)
                while end - start >= BLOCK_ROWS or (not last and start < end):
                    size = min(BLOCK_ROWS, end - start)
                    done.append(block(int(parts[start]), now.slice(start, size)))
                    start += size
            held = now.slice(start).combine_chunks()
            if done:
                yield written(done, held.column("label").type)
        if held is not None and held.num_rows:
            part = held.column("part")[0].as_py()
            yield written([block(part, held)], held.column("label").type)

    return run


def shortlist(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Indexes of the entries that can be nearest to a point of the box, ties included."""
    least = np.maximum(np.maximum(low - entries, entries - high), 0)
    most = np.maximum(np.abs(entries - low), np.abs(high - entries))
    return np.flatnonzero((least * least).sum(axis=1) <= (most * most).sum(axis=1).min())


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points to all entries.

    By a product of integer-valued doubles where every number on the way is exact, in
    whole integers otherwise.
    """
    width = max(points.shape[1], 1)
    top = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * width * top * top < EXACT:
        p, e = points.astype(float), entries.astype(float)
        far = (p * p).sum(axis=1)[:, None] - 2.0 * (p @ e.T) + (e * e).sum(axis=1)[None, :]
        return far.astype(np.int64)
    far = np.zeros((len(points), len(entries)), np.int64)
    for i in range(points.shape[1]):
        step = points[:, i].astype(np.int64)[:, None] - entries[:, i][None, :]
        far += step * step
    return far


def _assigned(batch: pa.RecordBatch, codebooks: list[np.ndarray], open_all: bool):
    """Per block (place, part, entry or entries of its points, distances, points)."""
    width = codebooks[0].shape[1]
    low, high = (_numbers(batch.column(c), "<i8", width) for c in ("low", "high"))
    points = batch.column("points")
    for i, part in enumerate(batch.column("part").to_pylist()):
        near = shortlist(low[i], high[i], codebooks[part])
        if len(near) == 1 and not open_all:
            yield i, part, int(near[0]), None, None
            continue
        own = np.frombuffer(points[i].as_py(), "<i4").reshape(-1, width)
        far = distances(own, codebooks[part][near])
        best = far.argmin(axis=1)
        yield i, part, near[best], far[np.arange(len(own)), best], own


def _round(codebooks: list[np.ndarray]):
    """The sums and counts of one task's points by their nearest entry."""
    width, size = codebooks[0].shape[1], len(codebooks[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((PARTS, size), np.int64)
        total = np.zeros((PARTS, size, width), np.int64)
        for batch in batches:
            sums = _numbers(batch.column("total"), "<i8", width)
            sizes = batch.column("n").to_numpy()
            for i, part, entry, _, own in _assigned(batch, codebooks, False):
                if own is None:
                    count[part, entry] += sizes[i]
                    total[part, entry] += sums[i]
                    continue
                order = np.argsort(entry, kind="stable")
                found, first = np.unique(entry[order], return_index=True)
                count[part, found] += np.diff(np.append(first, len(entry)))
                total[part, found] += np.add.reduceat(own[order].astype(np.int64), first, axis=0)
        part, entry = np.nonzero(count)
        if len(part):
            flat = pa.array(total[part, entry].ravel())
            ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part.astype(np.int32)),
                    pa.array(entry.astype(np.int32)),
                    pa.array(count[part, entry]),
                    pa.ListArray.from_arrays(ends, flat),
                ],
                names=["part", "entry", "n", "total"],
            )

    return run


def next_codebooks(blocks: DataFrame, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """One round: every used entry becomes the floored mean of its points."""
    width = codebooks[0].shape[1]
    sums = blocks.select("part", "n", "low", "high", "total", "points").mapInArrow(
        _round(codebooks), "part int, entry int, n bigint, total array<bigint>"
    )
    # At most one row per entry reaches the driver.
    rows = sums.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(width)]).alias("total")
    )
    out = [c.copy() for c in codebooks]
    for r in rows.collect():
        out[r.part][r.entry] = [t // r.n for t in r.total]
    return out


def _codes(codebooks: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = list(_assigned(batch, codebooks, True))
            sizes = [len(f[2]) for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("rows").flatten(),
                    batch.column("ids").flatten(),
                    batch.column("labels").flatten(),
                    pa.array(np.repeat([f[1] for f in found], sizes).astype(np.int32)),
                    pa.array(np.concatenate([f[2] for f in found]).astype(np.int32)),
                    pa.array(np.concatenate([f[3] for f in found])),
                ],
                names=["row", "vec_id", "label", "part", "entry", "far"],
            )

    return run


def codebooks_digest(codebooks: list[np.ndarray]) -> str:
    text = ",".join(str(x) for book in codebooks for x in book.ravel().tolist())
    return hashlib.sha256(text.encode()).hexdigest()


def usable_vectors(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> tuple[DataFrame, int]:
    """(vec_id, label, v) of the rows that take part, and the length of their vectors (0: none).

    Null vectors and those with null or non-finite components are dropped; so are vectors
    that are empty, not divisible into PARTS, or of another length than most of the rest
    (of equally frequent lengths the smallest counts).
    """
    rows = vectors.select(F.col(id).cast("bigint").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("v").isNotNull() & finite & (F.size("v") > 0) & (F.size("v") % PARTS == 0))
    lengths = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.orderBy(F.desc("n"), "dim").first()
    if most is None:
        return rows, 0
    return rows.where(F.size("v") == most.dim), most.dim


def compress(
    vectors: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    rounds: int = ROUNDS,
) -> tuple[DataFrame, list[np.ndarray]]:
    """((row, vec_id, label, code, error) per usable vector, the final codebooks by part).

    The rows that :func:`usable_vectors` names take part. A codebook starts as the parts
    of the ENTRIES rows with the smallest ids (ties by the vector, null ids last); with
    fewer rows it is shorter. Distance ties go to the lower entry, unused entries stay.
    Components beyond ``component_limit`` (x of 131,072 at 64 components) count as that
    limit. Repeated rows each give a row; an empty table gives no rows and no codebooks.
    Other columns are ignored. Equal input gives equal output, however it is partitioned.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    rows, dim = usable_vectors(vectors, id, vector, label)
    label_type = vectors.select(F.col(label)).schema[0].dataType
    slim = StructType([StructField("label", label_type)]).fields[0].dataType.simpleString()
    if not dim:
        return spark.createDataFrame([], f"row bigint, vec_id bigint, label {slim}, code string, error bigint"), []
    width = dim // PARTS
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").toArrow()
    start = integers(first.column("v").combine_chunks(), dim)
    codebooks = [start[:, p * width : (p + 1) * width] for p in range(PARTS)]

    # Numbers of one scan are the same when a task is repeated. The row is the last key, so
    # a point that many vectors share is still spread over ranges.
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    points = numbered.mapInArrow(
        _points(dim, codebooks),
        f"part int, key binary, row bigint, vec_id bigint, label {slim}, point binary",
    )
    ordered = points.repartitionByRange("part", "key", "row").sortWithinPartitions("part", "key", "row")
    blocks = stage(ordered.mapInArrow(_blocks(width), BLOCKS.format(label=slim)), "vector-blocks")
    for _ in range(rounds):
        codebooks = next_codebooks(blocks, codebooks)
    coded = blocks.mapInArrow(
        _codes(codebooks), f"row bigint, vec_id bigint, label {slim}, part int, entry int, far bigint"
    )

    def digits(part: int):
        return F.lower(F.lpad(F.hex(F.max(F.when(F.col("part") == part, F.col("entry")))), 2, "0"))

    found = coded.groupBy("row").agg(
        F.max("vec_id").alias("vec_id"),
        F.max("label").alias("label"),
        F.concat(*[digits(p) for p in range(PARTS)]).alias("code"),
        F.sum("far").alias("error"),
    )
    return found, codebooks


def with_label_error(found: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256).

    ``label_error`` sums the errors of equal labels, nulls together; a sum beyond a long
    is null. One row per label is broadcast if there are few labels.
    """
    found = stage(found, "vector-codes")
    sums = found.groupBy(F.col("label").alias("of_label")).agg(
        F.sum(F.col("error").cast("decimal(38,0)")).try_cast("bigint").alias("label_error")
    )
    joined = found.join(small_side(sums), F.col("label").eqNullSafe(F.col("of_label")))
    return joined.select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_digest(codebooks)).alias("codebooks_sha256")
    )
