"""Rules that look at one line at a time: key prefixes, secrets, first-match lists.

A file is first tested for the literals its rules need. Only files that pass are
cut into lines, and on those lines only the rules that passed are tried. All of it
is row-local: no shuffle, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SNIPPET_LENGTH, downgraded, entropy, is_comment, redact, strip
from ..rules import (
    ERROR_RULES,
    INSECURE_RULES,
    MIN_ENTROPY,
    MIN_SECRET_LENGTH,
    PREFIXES,
    SECRET_RULES,
    SQL_RULES,
    TEST_PATH_TOKENS,
    Rule,
    has_quote,
    java_pattern,
    valid_rules,
)
from ..schema import FINDING_COLUMNS, display_path, empty, findings, sql_text

HIT = "struct<severity:string,message:string>"
MASK_BITS = 62


def lines(files: DataFrame, *carry: str) -> DataFrame:
    """One row per line, numbered from 1; empty lines at the end are kept."""
    cut = F.posexplode(F.split("content", "\n")).alias("pos", "text")
    return files.select("project", "path", *carry, cut).select(
        "project", "path", *carry, (F.col("pos") + 1).alias("line"), "text"
    )


def drop_comments(line_rows: DataFrame, markers: Sequence[str] = ("#", "//")) -> DataFrame:
    return line_rows.where(~is_comment("text", markers))


# Rule lists can be long, so they are written as SQL text: one expression each.


def _hit(severity: str, message: str) -> str:
    return f"named_struct('severity', {sql_text(severity)}, 'message', {sql_text(message)})"


def rule_mask(text: str, lowered: str, rules: Sequence[Rule]) -> Column:
    """Which rules a text may match, as a bit set; 0 when none can."""
    bits = [
        f"IF({rule.possible_in_file(text, lowered)}, {1 << i}L, 0L)" for i, rule in enumerate(rules[:MASK_BITS])
    ]
    if len(rules) > MASK_BITS:
        bits.append(f"{1 << MASK_BITS}L")
    return F.expr(" + ".join(bits) if bits else "0L")


def _tries(text: str, mask: str | None, rules: Sequence[Rule]) -> list[str]:
    """For every rule, whether it may match at all and does.

    What must hold for the whole text must hold for the line of a match too, and most lines
    are left out by that without trying the pattern.
    """
    tests = []
    for i, rule in enumerate(rules):
        enabled = "" if mask is None or i >= MASK_BITS else f"({mask} & {1 << i}L) != 0 AND "
        tests.append(f"{enabled}{rule.possible_in(text, f'lower({text})')} AND {rule.found_in(text)}")
    return tests


def any_rule(text: str, mask: str, rules: Sequence[Rule]) -> Column:
    return F.expr(" OR ".join(f"({t})" for t in _tries(text, mask, rules)) or "false")


def first_match(text: str, rules: Sequence[Rule], mask: str | None = None) -> Column:
    """Severity and message of the first rule that finds something, else NULL."""
    whens = [
        f"WHEN {test} THEN {_hit(rule.severity, rule.message)}"
        for test, rule in zip(_tries(text, mask, rules), rules)
    ]
    return F.expr(f"CASE {' '.join(whens)} END" if whens else f"CAST(NULL AS {HIT})")


QUOTED_VALUE = r"""['"](.*?)['"]"""


def secret_match(
    text: str,
    rules: Sequence[Rule],
    mask: str | None = None,
    min_entropy: float = MIN_ENTROPY,
    min_length: int = MIN_SECRET_LENGTH,
) -> Column:
    """Like :func:`first_match`, but a quoted value must look random enough.

    A rule whose quoted value fails the gate gives way to the next rule.
    """
    quoted = java_pattern(QUOTED_VALUE)
    found = [
        f"IF({test}, named_struct('found', {rule.match_in(text)}, "
        f"'hit', {_hit(rule.severity, rule.message)}), NULL)"
        for test, rule in zip(_tries(text, mask, rules), rules)
    ]

    def passes(candidate: Column) -> Column:
        value = F.regexp_extract(candidate["found"], quoted, 1)
        random = (F.length(value) >= min_length) & (entropy(value) >= min_entropy)
        return candidate.isNotNull() & (~candidate["found"].rlike(quoted) | random)

    if not found:
        return F.lit(None).cast(HIT)
    return F.get(F.filter(F.expr(f"array({', '.join(found)})"), passes), F.lit(0))["hit"]


def prefix_pattern(*prefixes: str) -> str:
    return "['\"](?:" + "|".join("\\Q" + p + "\\E" for p in prefixes) + ")[A-Za-z0-9_\\-]{10,}['\"]"


def prefix_matches(text: str, prefixes: Sequence[tuple[str, str]]) -> Column:
    """Every known key prefix in a quoted literal; one text may give several hits."""
    found = [
        f"IF({text} RLIKE {sql_text(prefix_pattern(prefix))}, "
        f"{_hit('critical', f'Hardcoded {what} found in source code')}, NULL)"
        for prefix, what in prefixes
    ]
    return F.expr(f"array({', '.join(found)})")


@dataclass(frozen=True)
class LineGroup:
    """One independent set of line rules inside a scan.

    ``mask(text, lowered)`` tells from a whole file which rules can match at all,
    ``test(line, mask)`` whether a line is worth a closer look, and
    ``hits(line, mask)`` what it amounts to; all take column names.
    """

    name: str
    check: str
    mask: Callable[[str, str], Column]
    test: Callable[[str, str], Column]
    hits: Callable[[str, str], Column]
    comments: tuple[str, ...] = ("#", "//")
    downgrade: bool = False
    tag: str = ""
    whole_line: bool = False
    tokens: tuple[str, ...] = tuple(TEST_PATH_TOKENS)


def prefix_group(prefixes: Sequence[tuple[str, str]] = tuple(PREFIXES), **options) -> LineGroup:
    anywhere = sql_text(prefix_pattern(*[p for p, _ in prefixes]))
    settings = dict(
        check="security_scan", comments=("#", "//", "*"), downgrade=True, tag=" (test file)", whole_line=True
    )
    return LineGroup(
        name="prefix",
        mask=lambda text, _: F.expr(f"IF({has_quote(text)} AND {text} RLIKE {anywhere}, 1L, 0L)"),
        test=lambda text, mask: F.expr(f"{mask} != 0 AND {has_quote(text)} AND {text} RLIKE {anywhere}"),
        hits=lambda text, _: prefix_matches(text, prefixes),
        **{**settings, **options},
    )


def secret_group(
    rules: Sequence[Rule] = tuple(SECRET_RULES),
    min_entropy: float = MIN_ENTROPY,
    min_length: int = MIN_SECRET_LENGTH,
    **options,
) -> LineGroup:
    settings = dict(check="security_scan", comments=("#", "//", "*"), downgrade=True, whole_line=True)
    return LineGroup(
        name="secret",
        mask=lambda text, lowered: rule_mask(text, lowered, rules),
        test=lambda text, mask: any_rule(text, mask, rules),
        hits=lambda text, mask: F.array(secret_match(text, rules, mask, min_entropy, min_length)),
        **{**settings, **options},
    )


def first_match_group(name: str, check: str, rules: Sequence[Rule], **options) -> LineGroup:
    return LineGroup(
        name=name,
        check=check,
        mask=lambda text, lowered: rule_mask(text, lowered, rules),
        test=lambda text, mask: any_rule(text, mask, rules),
        hits=lambda text, mask: F.array(first_match(text, rules, mask)),
        **options,
    )


def insecure_group(rules: Sequence[Rule] = tuple(INSECURE_RULES)) -> LineGroup:
    return first_match_group("insecure", "security_scan", rules)


def error_group(rules: Sequence[Rule] = tuple(ERROR_RULES)) -> LineGroup:
    return first_match_group("error", "performance_lint", rules)


def sql_group(rules: Sequence[Rule] = tuple(SQL_RULES)) -> LineGroup:
    return first_match_group("sql", "performance_lint", rules)


def mask_column(group: LineGroup) -> str:
    return f"mask_{group.name}"


def with_masks(
    files: DataFrame,
    groups: Sequence[LineGroup],
    applies: dict[str, Column] | None = None,
    flags: dict[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """Add one bit set per rule group; 0 where the group does not apply to the file.

    ``flags`` are further columns by functions of the lowered text, so it is lowered once.
    """
    applies = applies or {}
    lowered = files.withColumn("__lowered", F.lower("content"))
    masks = {
        mask_column(g): F.when(
            applies.get(g.name, F.lit(True)), g.mask("content", "__lowered")
        ).otherwise(F.lit(0).cast("bigint"))
        for g in groups
    }
    more = {name: test(F.col("__lowered")) for name, test in (flags or {}).items()}
    return lowered.withColumns({**masks, **more}).drop("__lowered")


def any_mask(groups: Sequence[LineGroup]) -> Column:
    test = F.lit(False)
    for g in groups:
        test = test | (F.col(mask_column(g)) != 0)
    return test


def worth_a_look(text: str, groups: Sequence[LineGroup]) -> Column:
    """Cheap, compiled test that leaves only lines on which some rule matches."""
    test = F.lit(False)
    for g in groups:
        test = test | g.test(text, mask_column(g))
    return test


def line_hits(text: str, groups: Sequence[LineGroup]) -> Column:
    """What a line amounts to in every group: array<struct<g,hit>>, g = place of the group."""
    parts = []
    for i, group in enumerate(groups):
        mask = F.col(mask_column(group))
        hits = F.when(mask != 0, group.hits(text, mask_column(group))).otherwise(empty(HIT))
        parts.append(F.transform(hits, _tagged(i)))
    return F.filter(F.concat(*parts), lambda t: t["hit"].isNotNull())


def _tagged(i: int) -> Callable[[Column], Column]:
    return lambda hit: F.struct(F.lit(i).alias("g"), hit.alias("hit"))


def _per_group(which: Column, groups: Sequence[LineGroup], value: Callable[[LineGroup], Column]) -> Column:
    chain = None
    for i, group in enumerate(groups):
        chain = F.when(which == i, value(group)) if chain is None else chain.when(which == i, value(group))
    return chain


def not_comment(text: Column, which: Column, groups: Sequence[LineGroup]) -> Column:
    return ~_per_group(which, groups, lambda g: is_comment(text, g.comments))


def hit_columns(text: Column, shown: Column, which: Column, hit: Column, groups: Sequence[LineGroup]) -> dict[str, Column]:
    """Check, severity, message and snippet of one hit on one line."""
    tokens = {g.tokens for g in groups if g.downgrade}
    in_test = {t: downgraded(shown, t) for t in tokens}

    def severity(g: LineGroup) -> Column:
        if not g.downgrade:
            return hit["severity"]
        return F.when(in_test[g.tokens], F.lit("info")).otherwise(hit["severity"])

    def message(g: LineGroup) -> Column:
        if not (g.downgrade and g.tag):
            return hit["message"]
        return F.concat(hit["message"], F.when(in_test[g.tokens], F.lit(g.tag)).otherwise(F.lit("")))

    whole = _per_group(which, groups, lambda g: F.lit(g.whole_line))
    evidence = redact(strip(text))
    return {
        "check": _per_group(which, groups, lambda g: F.lit(g.check)),
        "severity": _per_group(which, groups, severity),
        "message": _per_group(which, groups, message),
        "snippet": F.left(evidence, F.when(whole, F.length(text) * 2 + 100).otherwise(F.lit(SNIPPET_LENGTH))),
    }


def hits_on(line_rows: DataFrame, groups: Sequence[LineGroup]) -> DataFrame:
    """Findings for line rows (project, path, line, text, masks)."""
    text = F.col("text")
    rows = line_rows.where(worth_a_look("text", groups))
    found = rows.select("project", "path", "line", "text", F.inline(line_hits("text", groups)))
    code = found.where(not_comment(text, F.col("g"), groups))
    columns = hit_columns(text, display_path(), F.col("g"), F.col("hit"), groups)
    return code.withColumn("file", display_path()).withColumns(columns).select(*FINDING_COLUMNS)


def line_scan(files: DataFrame, groups: Sequence[LineGroup]) -> DataFrame:
    """All findings of several rule groups in one pass over the files.

    Files on which no rule is possible yield no lines. That is part of the explode,
    not a filter before it: a filter would be pushed down and test each file twice.
    """
    masked = with_masks(files, groups)
    masks = [mask_column(g) for g in groups]
    cut = F.posexplode_outer(F.when(any_mask(groups), F.split("content", "\n"))).alias("pos", "text")
    rows = masked.select("project", "path", *masks, cut).where(F.col("pos").isNotNull())
    return hits_on(rows.withColumn("line", F.col("pos") + 1), groups)


def prefix_scan(files: DataFrame, prefixes: Sequence[tuple[str, str]] = tuple(PREFIXES)) -> DataFrame:
    return line_scan(files, [prefix_group(prefixes)])


def secret_scan(
    files: DataFrame,
    rules: Sequence[Rule] = tuple(SECRET_RULES),
    min_entropy: float = MIN_ENTROPY,
    min_length: int = MIN_SECRET_LENGTH,
) -> DataFrame:
    return line_scan(files, [secret_group(valid_rules(files.sparkSession, rules), min_entropy, min_length)])


def first_match_scan(
    files: DataFrame,
    rule_sets: dict[str, Sequence[Rule]] | Sequence[Rule],
    check: str = "security_scan",
) -> DataFrame:
    """First matching rule per line, independently for each named rule set."""
    if not isinstance(rule_sets, dict):
        rule_sets = {"rules": rule_sets}
    spark = files.sparkSession
    return line_scan(files, [first_match_group(n, check, valid_rules(spark, r)) for n, r in rule_sets.items()])


def rule_errors(spark: SparkSession, rules: Sequence[Rule], check: str = "security_scan") -> DataFrame:
    """One warning for every rule that is left out because its pattern doesn't compile."""
    usable = valid_rules(spark, rules)
    bad = [(r.pattern,) for r in rules if r not in usable]
    return findings(
        spark.createDataFrame(bad, "pattern string"),
        check=check,
        project=F.lit(None),
        severity="warning",
        file="(rules)",
        message=F.concat(F.lit("Rule left out, its pattern is invalid: "), "pattern"),
    ).select(*FINDING_COLUMNS)


def downgrade(found: DataFrame, tokens: Sequence[str] = tuple(TEST_PATH_TOKENS)) -> DataFrame:
    """Turn findings in test-like paths into ``info``."""
    severity = F.when(downgraded("file", tokens), F.lit("info")).otherwise(F.col("severity"))
    return found.withColumn("severity", severity)
