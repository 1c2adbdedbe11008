"""Word hashes of whole Arrow string columns in numpy.

A word is a longest run of bytes other than space and 0x09-0x0D; A-Z count as a-z.
Each word becomes a 64-bit hash. A column is worked through in segments that end
between words, so memory follows the segment size and the number of words, and no
text is cut short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

SEGMENT = 1 << 18
CHUNK_BYTES = 4 << 20
CHUNK_ROWS = 4096
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

_rng = np.random.default_rng(20240101)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.arange(256, dtype=np.uint8)
_SPACE = (_BYTE == 0x20) | ((_BYTE >= 0x09) & (_BYTE <= 0x0D))
_LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_VALUE_LOWER = np.where(_SPACE, np.uint64(0), _VALUE[_LOWER])
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, kept for usual sizes."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, 2 * SEGMENT)
        tables = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        if n > 4 * SEGMENT:
            return tables[0], tables[1]
        _powers = (tables[0], tables[1])
    return _powers


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _segments(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about SEGMENT bytes that end after white space."""
    start, n = 0, len(data)
    while start < n:
        end = min(start + SEGMENT, n)
        if end < n:
            gaps = np.flatnonzero(_SPACE[data[start:end]])
            if len(gaps):
                end = start + int(gaps[-1]) + 1
            else:
                while end < n and not _SPACE[data[end]]:
                    step = data[end : end + SEGMENT]
                    gaps = np.flatnonzero(_SPACE[step])
                    end += int(gaps[0]) if len(gaps) else len(step)
        yield start, end
        start = end


def _spans(data: np.ndarray, row_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in one segment; rows also end words."""
    word = ~_SPACE[data]
    starts, ends = word.copy(), word.copy()
    starts[1:] &= ~word[:-1] | row_start[1:]
    ends[:-1] &= ~word[1:] | row_start[1:]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def word_hashes(column: pa.Array, shapes: bool = False, tails: bool = False):
    """(offsets, hashes) of the words of each row; with ``shapes`` also shape hashes.

    With ``tails``, the last two bytes of each word, A-Z as a-z, as one number instead.

    The words of row i are ``hashes[offsets[i]:offsets[i + 1]]``. A shape is the word
    with letters, capitals, digits and each other ASCII sign as classes, runs as one.
    """
    data, at = column_bytes(column)
    row_start = np.zeros(len(data) + 1, bool)
    row_start[at] = True
    found, starts, shape_found = [], [], []
    for lo, hi in _segments(data):
        part = data[lo:hi]
        power, inverse = _power_tables(len(part))
        first, last = _spans(part, row_start[lo:hi])
        if not len(first):
            continue
        found.append(_range_hash(_VALUE_LOWER[part], first, last, power, inverse))
        starts.append(first + lo)
        if tails:
            low = _LOWER[part].astype(np.int64)
            before = np.where(last - 2 >= first, low[np.maximum(last - 2, 0)], 0)
            shape_found.append(low[last - 1] * 256 + before)
        elif shapes:
            kind = _SHAPE[part]
            new = np.ones(len(part), bool)
            new[1:] = (kind[1:] != kind[:-1]) | row_start[lo + 1 : hi]
            new[first] = True
            place = np.cumsum(new) - 1
            value = _VALUE[kind[new]]
            shape_found.append(_range_hash(value, place[first], place[last - 1] + 1, power, inverse))
    hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
    begins = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    offsets = np.searchsorted(begins, at).astype(np.int64)
    if shapes or tails:
        return offsets, hashes, np.concatenate(shape_found) if shape_found else np.zeros(0, np.int64)
    return offsets, hashes


def _range_hash(values, first, last, power, inverse) -> np.ndarray:
    total = np.cumsum(values * power[: len(values)])
    before = np.where(first > 0, total[first - 1], np.uint64(0))
    return mix((total[last - 1] - before) * inverse[first] + (last - first).astype(np.uint64))


def _shape_table() -> np.ndarray:
    table = _BYTE.copy()
    table[[*range(97, 123), *range(128, 256)]] = ord("a")
    table[65:91] = ord("A")
    table[48:58] = ord("0")
    return table


_SHAPE = _shape_table()


def chunks(batch: pa.RecordBatch, text: str, max_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``max_bytes`` of text, one row at least."""
    column = batch.column(batch.schema.get_field_index(text))
    size = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(size):
        if i > start and (total + n > max_bytes or i - start >= CHUNK_ROWS):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that long texts don't pile up in one batch."""
    spark.conf.set(ARROW_ROWS, str(CHUNK_ROWS))
    spark.conf.set(ARROW_BYTES, str(2 * CHUNK_BYTES))
