"""All matches of a pattern in a text, with their line numbers, row by row."""

from __future__ import annotations

from ..rules import java_pattern
from ..schema import sql_text

# A control character marks where a match starts; the same character in the text
# is first replaced by its neighbour, which no pattern tells apart from it.
MARK, STAND_IN = "\\u0001", "\\u0002"


def matched_lines(text: str, pattern: str, item: str, group: int = 0, possible: str = "true") -> str:
    """SQL for ``item`` over every non-overlapping match of ``pattern`` in column ``text``.

    ``item`` is a SQL expression over ``m.line`` (1-based) and ``m.found``. The
    pattern must not match the empty string. A text that fails ``possible`` or does
    not match gives NULL, after one pass over it at most.

    Each match start is marked, the text is cut into lines, and every line yields its
    number once per mark: linear in the text, with no running sums.
    """
    regex = sql_text(java_pattern(pattern))
    safe = f"replace({text}, '{MARK}', '{STAND_IN}')"
    marked = f"split(regexp_replace({safe}, {regex}, '{MARK}$0'), '\\n')"
    marks = f"length(l) - length(replace(l, '{MARK}', ''))"
    numbers = f"flatten(transform({marked}, (l, i) -> array_repeat(i + 1, {marks})))"
    found = f"regexp_extract_all({safe}, {regex}, {group})"
    pairs = f"transform(arrays_zip({numbers}, {found}), z -> named_struct('line', z.`0`, 'found', z.`1`))"
    return f"IF({possible} AND {text} RLIKE {regex}, transform({pairs}, m -> {item}), NULL)"
