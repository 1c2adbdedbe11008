"""Patterns with open gaps, matched by positions instead of by trying again.

A pattern such as ``supabase.from([^)]+).select(`` tries its gap anew behind every head, so
a long text with many heads takes time in the square of its length. Here such a rule is a
chain of short steps. The places of every step are found in one pass each; then, from the
last step to the first, each place is joined to the place of the next step that the plain
pattern would reach: the nearest within a distance, the last on the line, or the one at
the first stop sign. What is left to do is to follow the joined places from each head.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import Chain, Step

MATCH_TYPE = "array<struct<rule:int,line:int,found:string>>"
_MATCHES = pa.list_(pa.struct([("rule", pa.int32()), ("line", pa.int32()), ("found", pa.string())]))


def _places(text: str, pattern: str) -> tuple[list[int], list[int]]:
    found = [m.span() for m in re.finditer(pattern, text)]
    return [a for a, _ in found], [b for _, b in found]


def _next_place(step: Step, end: int, starts: Sequence[int], line_end: int, stops: Sequence[int]) -> int:
    """Index in ``starts`` of the place that a gap from ``end`` leads to, or -1."""
    first = bisect_left(starts, end + step.least)
    if first == len(starts):
        return -1
    if step.gap == "near":
        return first if starts[first] - end <= step.most else -1
    if step.gap == "line":
        last = bisect_right(starts, line_end) - 1
        return last if last >= first else -1
    stop = bisect_left(stops, end)
    return first if stop < len(stops) and stops[stop] == starts[first] else -1


def chain_spans(text: str, chain: Chain) -> list[tuple[int, int]]:
    """Spans of the matches, leftmost first and without overlap; linear but for look-ups."""
    lines = [m.start() for m in re.finditer("\n", text)] + [len(text)]
    steps = chain.steps
    starts, ends = _places(text, steps[-1].pattern)
    if chain.absent:
        unwanted = _places(text, chain.absent)[0]

        def free(end: int) -> bool:
            at = bisect_left(unwanted, end)
            return at == len(unwanted) or unwanted[at] - end > chain.within

        kept = [i for i, end in enumerate(ends) if free(end)]
        starts, ends = [starts[i] for i in kept], [ends[i] for i in kept]
    reach = ends
    for step, after in zip(reversed(steps[:-1]), reversed(steps[1:])):
        if not starts:
            return []
        own_starts, own_ends = _places(text, step.pattern)
        stops = [m.start() for m in re.finditer(re.escape(after.stop), text)] if after.stop else []
        good_starts, good_reach = [], []
        for start, end in zip(own_starts, own_ends):
            line_end = lines[bisect_left(lines, end)]
            at = _next_place(after, end, starts, line_end, stops)
            if at >= 0:
                good_starts.append(start)
                good_reach.append(reach[at])
        starts, reach = good_starts, good_reach
    spans, free_from = [], 0
    for start, end in zip(starts, reach):
        if start >= free_from:
            spans.append((start, end))
            free_from = end
    return spans


def chain_matches(text: Column, chains: Sequence[tuple[int, Chain, Column]]) -> Column:
    """Every match of several chains: array<struct<rule,line,found>>, NULL without any.

    Each chain comes with its rule's number and a cheap condition for a match; only texts
    that meet one are sent, once, with a bit set of the chains to try.
    """
    numbered = [(number, chain) for number, chain, _ in chains]

    def one(text: str | None, wanted: int) -> list[tuple] | None:
        if not text:
            return None
        breaks = [m.start() for m in re.finditer("\n", text)]
        return [
            (number, bisect_left(breaks, a) + 1, text[a:b])
            for i, (number, chain) in enumerate(numbered)
            if wanted >> i & 1
            for a, b in chain_spans(text, chain)
        ] or None

    def batch(texts: pa.Array, wanted: pa.Array) -> pa.Array:
        return pa.array([one(t, w) for t, w in zip(texts.to_pylist(), wanted.to_pylist())], type=_MATCHES)

    batch.__annotations__ = {"texts": pa.Array, "wanted": pa.Array, "return": pa.Array}
    bits = F.lit(0).cast("bigint")
    for i, (_, _, possible) in enumerate(chains):
        bits = bits + F.when(possible, F.lit(1 << i)).otherwise(F.lit(0))
    return F.arrow_udf(batch, returnType=MATCH_TYPE)(F.when(bits != 0, text), bits)
