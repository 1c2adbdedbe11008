"""Scalar text functions, all built from Spark SQL expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import SPACE, TEST_PATH_TOKENS, WORD

SNIPPET_LENGTH = 200
VERSION_PREFIX = r"^[\^~>=<! ]+"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(text: str | Column) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.regexp_replace(_col(text), rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def normalise_newlines(text: str | Column) -> Column:
    text = _col(text)
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text)


def is_comment(line: str | Column, markers: Iterable[str] = ("#", "//")) -> Column:
    """True where the line, without indentation, starts with a comment marker."""
    alternatives = "|".join("\\Q" + m + "\\E" for m in markers)
    return _col(line).rlike(rf"\A[{SPACE}]*(?:{alternatives})")


def basename(path: str | Column) -> Column:
    return F.substring_index(_col(path), "/", -1)


def in_basenames(path: str | Column, names: Iterable[str]) -> Column:
    return basename(path).isin(list(names))


def has_suffix(path: str | Column, suffixes: Iterable[str]) -> Column:
    path = _col(path)
    test = F.lit(False)
    for suffix in suffixes:
        test = test | path.endswith(suffix)
    return test


def file_lang(path: str | Column) -> Column:
    return (
        F.when(has_suffix(path, [".py"]), "python")
        .when(has_suffix(path, [".js", ".mjs", ".cjs", ".ts", ".tsx"]), "javascript")
        .otherwise("unknown")
    )


def downgraded(path: str | Column, tokens: Iterable[str] = tuple(TEST_PATH_TOKENS)) -> Column:
    """True where the path looks like test, mock or sample material."""
    lowered = F.lower(_col(path))
    test = F.lit(False)
    for token in tokens:
        test = test | F.contains(lowered, F.lit(token))
    return test


def entropy(text: str | Column) -> Column:
    """Shannon entropy in bits per character; 0.0 for empty text."""
    text = _col(text)
    length = F.length(text).cast("double")

    def term(char: Column) -> Column:
        share = (F.length(text) - F.length(F.replace(text, char, F.lit("")))).cast("double") / length
        return -share * F.log2(share)

    # An empty text splits into one empty string, whose share would divide by zero.
    chars = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    return F.when(
        text.isNotNull(),
        F.aggregate(F.transform(chars, term), F.lit(0.0), lambda acc, x: acc + x),
    )


def redact(text: str | Column, keep: int = 8) -> Column:
    """Cut every quoted literal longer than ``keep`` characters down to its head.

    The text is split into quoted literals and what lies between, so that a
    closing quote is never taken for an opening one.
    """
    tokens = F.regexp_extract_all(
        _col(text), F.lit("\"[^\"\n]+\"|'[^'\n]+'|[^\"']+|[\"']"), F.lit(0)
    )

    def shorten(token: Column) -> Column:
        literal = (F.length(token) > keep + 2) & token.rlike("\\A[\"']")
        head = F.substring(token, 1, keep + 1)
        return F.when(literal, F.concat(head, F.lit("...REDACTED"), F.right(token, F.lit(1)))).otherwise(token)

    return F.array_join(F.transform(tokens, shorten), "")


def snippet(line: str | Column, length: int = SNIPPET_LENGTH) -> Column:
    """One line as evidence: stripped, quoted literals redacted, then cut.

    Redaction comes first: a literal cut in half would no longer look quoted.
    """
    return F.left(redact(strip(line)), F.lit(length))


def multiline_snippet(match: str | Column, length: int = SNIPPET_LENGTH) -> Column:
    """A multi-line match as evidence: cut first, newlines shown as `` | ``."""
    return F.replace(F.left(_col(match), F.lit(length)), F.lit("\n"), F.lit(" | "))


def clean_version(version: str | Column) -> Column:
    return F.regexp_replace(_col(version), VERSION_PREFIX, "")


def parse_version(version: str | Column) -> Column:
    """Leading one to three dotted integers as an array, NULL without any.

    A part too long for a number counts as the largest, so that later parts keep their
    places.
    """
    cleaned = clean_version(version)
    number = r"\A(\d+)(?:\.(\d+))?(?:\.(\d+))?"
    texts = F.filter(F.array(*[F.regexp_extract(cleaned, number, g) for g in (1, 2, 3)]), lambda p: p != "")
    most = F.lit((1 << 63) - 1)
    parts = F.transform(texts, lambda p: F.coalesce(p.try_cast("bigint"), most))
    return F.when(F.size(parts) > 0, parts)


def age_days(mtime: str | Column, as_of: str | Column) -> Column:
    """Age in days as a fraction; callers truncate for display."""
    seconds = F.unix_micros(_col(as_of)) - F.unix_micros(_col(mtime))
    return seconds / F.lit(86_400_000_000.0)


def normalised_code(block: str | Column) -> Column:
    """Text with comments gone, strings as STR, space collapsed and words as ID."""
    text = F.regexp_replace(_col(block), r"//[^\n]*|/\*[\s\S]*?\*/", "")
    # Possessive groups run as loops in the JVM; plain ones recurse per character.
    text = F.regexp_replace(
        text,
        r"'(?:[^'\\\n]++|\\[^\n])*+'|" + r'"(?:[^"\\\n]++|\\[^\n])*+"|' + r"`(?:[^`\\\n]++|\\[^\n])*+`",
        "STR",
    )
    # Single spaces stay as they are, which spares most of the replacements.
    text = F.trim(F.regexp_replace(text, f"[{SPACE}&&[^ ]][{SPACE}]*+| [{SPACE}]++", " "))
    return F.regexp_replace(
        text, rf"(?<![{WORD}])[a-zA-Z_][{WORD}]*+|(?<=[{WORD}])\$[{WORD}]++", "ID"
    )


def text_fingerprint(block: str | Column) -> Column:
    """Digest that is equal for texts of the same shape."""
    return F.md5(normalised_code(block).cast("binary"))
