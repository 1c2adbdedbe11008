"""Benchmark decontamination: pigeonhole pieces and Myers bit-parallel distance.

Both sides are compared with A-Z as a-z and runs of white space as one space. A test
item of n characters may occur with up to k = n * error_rate edits. It is cut into
k + 1 pieces; k edits leave one piece whole, so every occurrence holds a piece exactly.
An Aho-Corasick automaton finds piece hits in one pass over a text, and around each
hit Myers' algorithm computes the smallest distance of the item to any part of the text.
Short items must occur exactly and between word borders, as they are inside words by chance.

The benchmark is a query set against all rows: it goes to the tasks in blocks of
``BLOCK_BYTES``, one pass over the documents for each block, so its size is not bounded
by a task's memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import bound_batches, chunks

ERROR_RATE = 0.08
MIN_CHARS = 24
BLOCK_BYTES = 8 << 20
MATCHES = "doc_id bigint, item_id bigint, distance int, begin bigint, end bigint"


def normal(text: str | None) -> str:
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()).decode("utf-8", "surrogatepass")


def pieces(length: int, budget: int) -> list[tuple[int, int]]:
    """``budget`` + 1 ranges of near equal length that cover 0..length."""
    n = budget + 1
    cut = [length * i // n for i in range(n + 1)]
    return list(zip(cut[:-1], cut[1:]))


def best_match(pattern: str, text: str) -> tuple[int, int]:
    """(distance, end) of the part of ``text`` nearest to ``pattern``; the first such end."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    eq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        eq[c] = eq.get(c, 0) | 1 << i
    up, down, score = full, 0, m
    best, at = m, 0
    for j, c in enumerate(text, 1):
        e = eq.get(c, 0)
        x = e | down
        h = (((e & up) + up) ^ up) | e
        ph = down | (full & ~(h | up))
        mh = up & h
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, at = score, j
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        up = mh | (full & ~(x | ph))
        down = ph & x
    return best, at


def whole(pattern: str, text: str, ranges: list[tuple[int, int]]) -> int | None:
    """Where ``pattern`` first stands in one of the ranges of ``text`` without a letter or digit going on beyond it."""

    def inside(at: int) -> bool:
        return 0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum()

    for lo, hi in ranges:
        at = text.find(pattern, lo, hi)
        while at >= 0:
            if not inside(at) and not inside(at + len(pattern)):
                return at
            at = text.find(pattern, at + 1, hi)
    return None


class Items:
    """A block of test items, ready for matching."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float, min_chars: int):
        self.items: list[tuple[int, str, int]] = []
        self.min_chars = min_chars
        places: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            text = normal(text)
            if not text:
                continue
            budget = int(len(text) * error_rate) if len(text) >= min_chars else 0
            for lo, hi in pieces(len(text), budget):
                places.setdefault(text[lo:hi], []).append((len(self.items), lo))
            self.items.append((item_id, text, budget))
        self.machine = ahocorasick.Automaton()
        for piece, where in places.items():
            self.machine.add_word(piece, (len(piece), where))
        if places:
            self.machine.make_automaton()

    def windows(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """For each item hit by a piece, the merged ranges of text that may hold it."""
        found: dict[int, set[int]] = {}
        if self.items:
            for last, (length, where) in self.machine.iter(text):
                for item, offset in where:
                    found.setdefault(item, set()).add(last + 1 - length - offset)
        out = {}
        for item, starts in found.items():
            _, pattern, budget = self.items[item]
            ranges: list[list[int]] = []
            for s in sorted(starts):
                lo, hi = max(0, s - budget), s + len(pattern) + budget
                if ranges and lo <= ranges[-1][1]:
                    ranges[-1][1] = hi
                else:
                    ranges.append([lo, hi])
            out[item] = [(a, b) for a, b in ranges]
        return out

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, begin, end) of the best occurrence of each item in a normal text."""
        rows = []
        for item, ranges in self.windows(text).items():
            item_id, pattern, budget = self.items[item]
            if len(pattern) < self.min_chars:
                begin = whole(pattern, text, ranges)
                if begin is not None:
                    rows.append((item_id, 0, begin, begin + len(pattern)))
                continue
            best = None
            for lo, hi in ranges:
                distance, end = best_match(pattern, text[lo:hi])
                if distance <= budget and (best is None or distance < best[0]):
                    best = (distance, lo, lo + end)
            if best:
                distance, lo, end = best
                _, back = best_match(pattern[::-1], text[lo:end][::-1])
                rows.append((item_id, distance, end - back, end))
        return rows


def source_places(text: str) -> list[int]:
    """For each character of the normal text, its place in the text itself."""
    places, gap, seen = [], False, False
    for i, c in enumerate(text):
        if c in " \t\n\r\x0b\x0c":
            gap = seen
        else:
            if gap:
                places.append(i - 1)
            places.append(i)
            gap, seen = False, True
    return places


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of bounded size; a null id, null or empty text is left out."""
    items = benchmark.select(F.col("item_id").cast("bigint"), "text").where(
        F.col("item_id").isNotNull() & (F.length("text") > 0)
    )
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // BLOCK_BYTES) + 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for i in range(n):
        rows = items.where(block == i).distinct().collect()
        yield sorted((r.item_id, r.text) for r in rows)


def find_items(
    docs: DataFrame,
    benchmark: DataFrame,
    error_rate: float = ERROR_RATE,
    min_chars: int = MIN_CHARS,
    id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document and test item found in it: doc_id, item_id, distance, begin, end.

    ``begin`` and ``end`` (exclusive) are code points of the document's own text, of the
    occurrence with the smallest distance, the first of several. Items that are shorter
    than ``min_chars`` must occur without an edit and not inside a longer word. Null and
    empty texts match nothing. Repeated documents give a row each. Other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))

    def search(items: list[tuple[int, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = Items(items, error_rate, min_chars)
            for batch in batches:
                for part in chunks(batch, "text"):
                    out = []
                    for doc_id, raw in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                        found = block.matches(normal(raw))
                        if found:
                            places = source_places(raw)
                            out += [
                                (doc_id, i, d, places[a] if a < b else 0, places[b - 1] + 1 if a < b else 0)
                                for i, d, a, b in found
                            ]
                    columns = zip(*out) if out else [[]] * 5
                    types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(c), t) for c, t in zip(columns, types)],
                        names=["doc_id", "item_id", "distance", "begin", "end"],
                    )

        return rows.mapInArrow(run, MATCHES)

    return reduce(DataFrame.unionByName, [search(items) for items in _blocks(benchmark)])


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS
) -> DataFrame:
    """The documents in which no test item occurs, with all their columns.

    Each row is judged by its own text, so repeated or missing ids don't matter.
    """
    bound_batches(docs.sparkSession)

    def keep(items: list[tuple[int, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = Items(items, error_rate, min_chars)
            for batch in batches:
                for part in chunks(batch, "text"):
                    clean = [not block.matches(normal(raw)) for raw in part.column("text").to_pylist()]
                    yield part.filter(pa.array(clean, pa.bool_()))

        return run

    for items in _blocks(benchmark):
        docs = docs.mapInArrow(keep(items), docs.schema)
    return docs
