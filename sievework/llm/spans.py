"""Matches of patterns as spans of code points, in SQL functions alone.

The text is split at the matches; lengths of gaps and matches give the places. The sums
run within blocks of ``BLOCK`` matches and then over blocks. What lists of spans have to
do with each other is read from ranks in sorted lists. So the work on a text grows with
its length and, but for sorting, with its number of matches. Patterns must not match the
empty string, and must be written so that a search is linear: maximal runs with a guard
at their start, and possessive loops.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import sql_text

BLOCK = 256
HIT = "struct<start:bigint,end:bigint,found:string,before:string,after:string>"
SPAN = "struct<start:bigint,end:bigint,kind:string>"


def hits(text: str, pattern: str, possible: str = "true", around: int = 0) -> Column:
    """array<struct<start,end,found,before,after>> of the matches in column ``text``, in order.

    ``before`` holds the ``around`` code points before the match, ``after`` the one behind
    it; both are empty if ``around`` is 0. ``possible`` is a cheap SQL test that texts with
    a match pass. Null texts have none.
    """
    regex = sql_text(pattern)
    none = f"CAST(array() AS array<{HIT}>)"
    pairs = f"arrays_zip(split({text}, {regex}, -1), regexp_extract_all({text}, {regex}, 0))"
    last = (lambda *parts: f"right(concat({', '.join(parts)}), {around})") if around else (lambda *parts: "''")
    after = "left(concat(p[j + 1].`0`, coalesce(p[j + 1].`1`, '')), 1)" if around else "''"
    one = f"named_struct('gap', p[j].`0`, 'found', p[j].`1`, 'after', {after})"
    # The last pair is the rest of the text, without a match.
    cut = (
        f"transform(sequence(0, size(p) - 2, {BLOCK}), "
        f"i -> transform(sequence(i, least(i + {BLOCK}, size(p) - 1) - 1), j -> {one}))"
    )
    step = (
        f"named_struct('at', a.at + length(z.gap) + length(z.found), 'tail', {last('a.tail', 'z.gap', 'z.found')}, "
        "'out', concat(a.out, array(named_struct('start', a.at + length(z.gap), "
        "'end', a.at + length(z.gap) + length(z.found), 'found', z.found, "
        f"'before', {last('a.tail', 'z.gap')}, 'after', z.after))))"
    )
    block = f"aggregate(b, named_struct('at', 0L, 'tail', '', 'out', {none}), (a, z) -> {step})"
    shift = (
        "named_struct('start', a.at + h.start, 'end', a.at + h.end, 'found', h.found, "
        f"'before', {last('a.tail', 'h.before')}, 'after', h.after)"
    )
    join = (
        f"named_struct('at', a.at + b.at, 'tail', {last('a.tail', 'b.tail')}, "
        f"'out', concat(a.out, array(transform(b.out, h -> {shift}))))"
    )
    empty = f"named_struct('at', 0L, 'tail', '', 'out', CAST(array() AS array<array<{HIT}>>))"
    whole = f"aggregate(transform({cut}, b -> {block}), {empty}, (a, b) -> {join}, a -> flatten(a.out))"
    found = f"element_at(transform(array({pairs}), p -> IF(size(p) < 2, {none}, {whole})), 1)"
    return F.expr(f"IF(({possible}) AND {text} RLIKE {regex}, {found}, {none})")


def smaller(points: Column, places: Column) -> Column:
    """array<bigint>: for each of ``places`` the number of ``points`` below it.

    Both are arrays of struct<k,at> and compare by k, then at. A place's rank among both,
    less its rank among the places, is the number of points before it.
    """
    events = F.concat(
        F.transform(points, lambda x: _event(x, 1, F.lit(-1))), F.transform(places, lambda x, i: _event(x, 0, i))
    )
    ranked = F.transform(F.sort_array(events), lambda e, at: F.struct(e["i"].alias("i"), at.alias("at")))
    own = F.filter(ranked, lambda e: e["i"] >= 0)
    back = F.transform(own, lambda e, n: F.struct(e["i"].alias("i"), (e["at"] - n).cast("bigint").alias("n")))
    return F.transform(F.sort_array(back), lambda e: e["n"])


def _event(x: Column, tag: int, i: Column) -> Column:
    return F.struct(
        x["k"].cast("bigint").alias("k"), x["at"].cast("bigint").alias("at"), F.lit(tag).alias("tag"), i.alias("i")
    )


def place(k: Column | int, at: Column) -> Column:
    k = k if isinstance(k, Column) else F.lit(k)
    return F.struct(k.cast("bigint").alias("k"), at.cast("bigint").alias("at"))


def touching(
    ones: Column,
    others: Column,
    one_key: Callable[[Column], Column | int] = lambda s: 0,
    other_key: Callable[[Column], Column | int] = lambda s: 0,
) -> Column:
    """array<bigint>: for each of ``ones`` how many of ``others`` with its key overlap it.

    Those that start before its end, without those that end before its start. ``ones``
    and ``others`` should be columns, as they are read several times.
    """
    begun = smaller(
        F.transform(others, lambda o: place(other_key(o), o["start"])),
        F.transform(ones, lambda s: place(one_key(s), s["end"])),
    )
    ended = smaller(
        F.transform(others, lambda o: place(other_key(o), o["end"])),
        F.transform(ones, lambda s: place(one_key(s), s["start"] + 1)),
    )
    return F.zip_with(begun, ended, lambda b, e: b - e)


def spans(found: Column, kind: str) -> Column:
    return F.transform(
        found, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), F.lit(kind).alias("kind"))
    )


def in_order(all_spans: Column, kinds: Sequence[str]) -> Column:
    """By start, then kind as listed, then end; repeated spans once."""
    rank = F.array(*[F.lit(k) for k in kinds])
    keyed = F.transform(
        all_spans,
        lambda s: F.struct(s["start"].alias("start"), F.array_position(rank, s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind")),
    )
    # One element with the sorted list, so that the list is made once.
    ordered = F.transform(
        F.array(F.sort_array(keyed)), lambda a: F.filter(a, lambda s, i: (i == 0) | (s != a[F.greatest(i - 1, F.lit(0))]))
    )
    return F.element_at(ordered, 1)


def listed(ordered: Column) -> Column:
    """kind:start:end, comma-joined."""
    one = F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def number_of(column: str, kind: str) -> Column:
    return F.size(F.filter(column, lambda s: s["kind"] == kind)).cast("bigint")


def digest(ordered: Column) -> Column:
    return F.sha2(listed(ordered).cast("binary"), 256)


def masked(text: Column, ordered: Column, shown: str = "[{}]") -> Column:
    """The text with every span replaced by its kind; overlapping spans by the first."""
    before, after = (F.lit(p) for p in shown.split("{}"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        gap = F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
        return F.when(s["start"] < a["at"], a).otherwise(
            F.struct(s["end"].alias("at"), F.concat(a["out"], gap, before, s["kind"], after).alias("out"))
        )

    rest = F.length(text).cast("int")
    return F.aggregate(ordered, start, step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), rest)))


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the check digit of a digit string holds."""
    back = F.reverse(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0

