"""A bound on the work of one file.

Some searches have a head and an open gap up to a closing sign: where the sign is missing
they read on to the next one behind every head. What that costs is known beforehand: the
sum, over the stretches between closing signs, of the heads in it times its length. Files
beyond ``MAX_STEPS`` leave out that search and give a warning in place of its results.
Patterns of users, of which nothing is known, are not tried on lines beyond
``MAX_USER_LINE`` characters, which likewise gives a warning.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import MAX_USER_LINE, SPACE, WORD, Rule, holds
from ..schema import fact, facts_when, sql_text

MAX_STEPS = 500_000_000
# A shorter text can't need more steps than that.
SMALL_TEXT = 20_000
TOO_MUCH = f"Check skipped: more than {MAX_STEPS} steps estimated"
LONG_LINE = f"Check skipped: user rules are not tried on lines of more than {MAX_USER_LINE} characters"


@dataclass(frozen=True)
class OpenSearch:
    """A search of one check: its head, and the sign up to which it reads on."""

    check: str
    needle: str
    head: str
    closer: str


IMPORTS = OpenSearch("dead_code", "import", rf"import[{SPACE}]+\{{", r"\}")
ARROWS = OpenSearch(
    "duplicate_code", "=", rf"(?:const|let|var)[{SPACE}]+[{WORD}]+[{SPACE}]*=[{SPACE}]*(?:async[{SPACE}]+)?\(", r"\)"
)


def steps(text: str, search: OpenSearch) -> Column:
    """About how many characters the search reads in the text of a column."""
    heads = f"regexp_count(part, {sql_text(search.head)})"
    cut = f"split({text}, {sql_text(search.closer)})"
    total = f"aggregate({cut}, 0D, (sum, part) -> sum + CAST({heads} AS DOUBLE) * length(part))"
    return F.expr(f"IF(octet_length({text}) > {SMALL_TEXT} AND {holds(text, search.needle)} AND length({text}) > {SMALL_TEXT}, {total}, 0D)")


def too_much(text: str, search: OpenSearch) -> Column:
    return F.coalesce(steps(text, search) > MAX_STEPS, F.lit(False))


def skipped(condition: Column, check: str, message: str = TOO_MUCH) -> Column:
    """The warning of a file that leaves out part of a check: facts."""
    return facts_when(condition, F.array(fact(kind="finding", check=check, severity="warning", message=message)))


def long_for_users(text: str, rules: Sequence[Rule]) -> Column:
    """Whether a user's rule may match the text, but a line is too long to try it."""
    lowered = f"lower({text})"
    own = [r.possible_in(text, lowered) for r in rules if r.of_user]
    if not own:
        return F.lit(False)
    return F.coalesce(
        F.expr(
            f"octet_length({text}) > {MAX_USER_LINE} AND length({text}) > {MAX_USER_LINE} AND ({' OR '.join(own)}) "
            f"AND exists(split({text}, '\\n'), l -> length(l) > {MAX_USER_LINE})"
        ),
        F.lit(False),
    )
