"""Column functions: text, versions, dates and regular-expression matches."""

from .matching import matched_lines
from .text import (
    age_days,
    clean_version,
    downgraded,
    entropy,
    file_lang,
    has_suffix,
    in_basenames,
    is_comment,
    multiline_snippet,
    normalise_newlines,
    parse_version,
    redact,
    snippet,
    strip,
    text_fingerprint,
)

__all__ = [
    "age_days", "clean_version", "downgraded", "entropy", "file_lang", "has_suffix",
    "in_basenames", "is_comment", "matched_lines", "multiline_snippet",
    "normalise_newlines", "parse_version", "redact", "snippet", "strip", "text_fingerprint",
]
