"""Rules that look at a whole text: multi-line patterns and loop bodies.

All row-local. Patterns run on the text as it is; the two loop rules, whose pattern
would need a repeated group over any number of lines, are a fold over line flags.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matching import matched_lines
from ..functions.text import file_lang, multiline_snippet, redact
from .gaps import chain_matches
from ..rules import LOOP_RULES, PERFORMANCE_RULES, SPACE, LoopRule, Rule, java_pattern, valid_rules
from ..schema import FINDING_COLUMNS, display_path, empty

CHECK = "performance_lint"
MATCH = "struct<rule:int,line:int,found:string>"


def _match(rule: int, line: Column, found: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), line.cast("int").alias("line"), found.alias("found"))


def _possible(text: str, rule: Rule) -> str:
    return rule.possible_in_file(text, f"lower({text})" if rule.ignores_case else text)


def pattern_matches(text: str, rule: Rule, number: int) -> Column:
    """Every non-overlapping match of one rule: array<MATCH>, NULL without any."""
    item = f"named_struct('rule', {number}, 'line', m.line, 'found', m.found)"
    return F.expr(matched_lines(text, rule.pattern, item, possible=_possible(text, rule)))


def text_matches(text: str, rules: Sequence[Rule | LoopRule], lang: Column | None = None) -> Column:
    """Matches of all rules, numbered by place; rules with a language need that file language."""
    parts, chains = [], []
    for number, rule in enumerate(rules):
        speaks = lang == rule.lang if rule.lang != "any" and lang is not None else F.lit(True)
        if isinstance(rule, LoopRule):
            part = F.when(F.expr(rule.possible_in(text)), loop_matches(F.col(text), rule, number))
        elif rule.chain:
            chains.append((number, rule.chain, speaks & F.expr(_possible(text, rule))))
            continue
        else:
            part = pattern_matches(text, rule, number)
        parts.append(F.coalesce(F.when(speaks, part), empty(MATCH)))
    if chains:
        parts.append(F.coalesce(chain_matches(F.col(text), chains), empty(MATCH)))
    return F.concat(*parts) if parts else empty(MATCH)


def match_columns(rule: Column, found: Column, rules: Sequence[Rule | LoopRule]) -> dict[str, Column]:
    """Severity, message and snippet for a rule number and the matched text."""

    def pick(values: Sequence[str]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), rule + 1)

    return {
        "check": F.lit(CHECK),
        "severity": pick([r.severity for r in rules]),
        "message": pick([r.message for r in rules]),
        "snippet": multiline_snippet(redact(found)),
    }


# A line that ends in a colon with something before it. Only the first sign of each stretch
# between line separators is tried as a beginning, and only its last colon as the end.
BREAKS = r"\r\u0085\u2028\u2029"
TAIL = rf"(?:\A|[{BREAKS}])[{SPACE}&&[^{BREAKS}]]*+[^{SPACE}](?>[^{BREAKS}]*:)[{SPACE}]*+\z"

# Line flags of the loop fold.
HEADER, HEADER_HEAD, HEADER_TAIL, CALL, BLANK, INDENTED = 1, 2, 4, 8, 16, 32


def _loop_spans(text: Column, rule: LoopRule) -> Column:
    """Line spans from a loop header to the first call in what follows: array<struct<first,last>>.

    The body goes on while lines are indented or follow a blank line. A header may
    also be broken after its keyword. After a hit the search goes on below it.
    """
    ends = rf"[{SPACE}]*\z"
    header = java_pattern(rule.linear) if rule.linear else java_pattern(rule.header) + ends

    def flag(test: Column, bit: int) -> Column:
        return F.when(test, F.lit(bit)).otherwise(F.lit(0))

    def flags(line: Column) -> Column:
        return (
            flag(line.rlike(header), HEADER)
            + flag(line.rlike(java_pattern(rule.keyword) + ends), HEADER_HEAD)
            + flag(line.rlike(TAIL), HEADER_TAIL)
            + flag(line.rlike(java_pattern(rule.call)), CALL)
            + flag(line.rlike(rf"\A{ends}"), BLANK)
            + flag(line.rlike(rf"\A[{SPACE}]"), INDENTED)
        )

    def on(value: Column, bit: int) -> Column:
        return value.bitwiseAND(F.lit(bit)) != 0

    span = "struct<first:int,last:int>"
    start = F.struct(
        F.lit(0).alias("i"),
        F.lit(0).alias("open"),
        F.lit(0).alias("broken"),
        F.lit(False).alias("after_blank"),
        F.array().cast(f"array<{span}>").alias("found"),
    )

    def step(state: Column, value: Column) -> Column:
        i = state["i"] + 1
        going = (state["open"] > 0) & (on(value, INDENTED) | on(value, BLANK) | state["after_blank"])
        hit = going & on(value, CALL)
        completes = (state["broken"] > 0) & on(value, HEADER_TAIL)
        opened = (
            F.when(going, state["open"])
            .when(completes, state["broken"])
            .when(on(value, HEADER), i)
            .otherwise(F.lit(0))
        )
        waits = F.when((state["broken"] > 0) & on(value, BLANK), state["broken"])
        broken = waits.when(on(value, HEADER_HEAD), i).otherwise(F.lit(0))
        return F.struct(
            i.alias("i"),
            F.when(hit, F.lit(0)).otherwise(opened).alias("open"),
            F.when(hit, F.lit(0)).otherwise(broken).alias("broken"),
            on(value, BLANK).alias("after_blank"),
            F.when(
                hit,
                F.concat(
                    state["found"],
                    F.array(F.struct(state["open"].alias("first"), i.alias("last"))),
                ),
            )
            .otherwise(state["found"])
            .alias("found"),
        )

    values = F.transform(F.split(text, "\n"), flags)
    return F.aggregate(values, start, step)["found"]


def loop_matches(text: Column, rule: LoopRule, number: int) -> Column:
    """Loop headers whose body reaches a call: array<MATCH>."""
    rows = F.split(text, "\n")
    header, call = java_pattern(rule.header), java_pattern(rule.call)
    keyword = java_pattern(rule.keyword)

    def built(span: Column) -> Column:
        opening = F.element_at(rows, span["first"])
        whole = F.regexp_extract(opening, header + r"[^\n]*", 0)
        broken = F.regexp_extract(opening, keyword + rf"[{SPACE}]*\z", 0)
        head = F.when(whole != "", whole).otherwise(broken)
        body = F.slice(rows, span["first"] + 1, span["last"] - span["first"] - 1)
        last = F.regexp_extract(F.element_at(rows, span["last"]), r".*" + call, 0)
        return _match(number, span["first"], F.array_join(F.concat(F.array(head), body, F.array(last)), "\n"))

    spans = F.transform(_loop_spans(text, rule), built)
    return F.when(text.rlike(call) & text.rlike(keyword), spans).otherwise(empty(MATCH))


def match_findings(files: DataFrame, rules: Sequence[Rule | LoopRule], lang: Column | None) -> DataFrame:
    rules = [*valid_rules(files.sparkSession, rules)]
    matches = text_matches("content", rules, lang)
    rows = files.select("project", "path", F.inline(matches))
    columns = match_columns(F.col("rule"), F.col("found"), rules)
    return rows.withColumn("file", display_path()).withColumns(columns).select(*FINDING_COLUMNS)


def multiline_scan(
    files: DataFrame, rules: Sequence[Rule | LoopRule] = tuple(PERFORMANCE_RULES), lang_col: str | None = None
) -> DataFrame:
    """Every match of every rule; a rule with a language only runs on files of it.

    The language comes from ``lang_col`` or, without one, from the file suffix.
    """
    return match_findings(files, rules, F.col(lang_col) if lang_col else file_lang("path"))


def loop_scan(files: DataFrame, rules: Sequence[LoopRule] = tuple(LOOP_RULES)) -> DataFrame:
    """Loops that reach a call in their body."""
    return match_findings(files, rules, file_lang("path"))


def absent_within(files: DataFrame, x: str, y: str, n: int, message: str, severity: str = "warning") -> DataFrame:
    """Matches of ``x`` with no ``y`` starting in the next ``n`` characters."""
    return multiline_scan(files, [Rule(rf"(?:{x})(?![\s\S]{{0,{n}}}(?:{y}))", message, severity)])
