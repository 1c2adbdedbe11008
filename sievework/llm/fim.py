"""Fill-in-the-middle training texts by one counted match per text, in SQL functions.

A unit is a run of ASCII letters or one other code point. ``regexp_count`` counts a text's
units; the two cuts come from a digest of its id. A pattern written for the row takes
exactly so many units for the prefix and so many for the middle, in possessive groups
that are neither tried again nor nested on the stack, and the rest is the suffix: one match
writes the output in its final order. The marks can't be confused with text: a text that
holds one stays plain, and no mark begins inside another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = "(?:[A-Za-z]++|[^A-Za-z])"
PLAIN_PERCENT = 10
SPM_PERCENT = 20

# Markers and groups: prefix 1, middle 2, suffix 3.
PSM = f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2"
SPM = f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2"


def _draws(id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from a digest of the seed and the decimal id (null: empty)."""
    row = F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit("")))
    digest = F.sha2(row.cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def _cut_pattern(first: Column, second: Column) -> Column:
    """A pattern that takes ``first`` units, then ``second`` units, then the rest."""
    return F.concat(
        F.lit(rf"(?s)\A({UNIT}{{"),
        first.cast("string"),
        F.lit(rf"}}+)({UNIT}{{"),
        second.cast("string"),
        F.lit(r"}+)(.*)\z"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text from its output and form alone."""
    psm = F.regexp_replace(output, rf"(?s)\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*)\z", "$1$3$2")
    spm = F.regexp_replace(output, rf"(?s)\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*)\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    seed: int = 1,
    plain_percent: int = PLAIN_PERCENT,
    spm_percent: int = SPM_PERCENT,
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), one row per row of ``docs``.

    ``n`` counts the units and ``form`` is plain, psm (prefix, suffix, middle) or spm
    (suffix, prefix, middle). A null text counts as empty; empty texts and texts with a
    mark in them are plain, with null lengths. Lengths are in code points. Rows with
    equal ids are cut by the same digest (a null id by that of the bare seed), equal rows
    give equal rows, an empty table gives none, and other columns are ignored whatever
    their names. Texts of any length are cut whole, in time linear in the text.
    """
    source = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("whole"))
    first, second, plain, order = _draws(F.col("doc_id"), seed)
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("whole", F.lit(mark))
    form = (
        F.when((F.col("whole") == "") | marked | (plain % 100 >= 100 - plain_percent), "plain")
        .when(order % 100 < spm_percent, "spm")
        .otherwise("psm")
    )
    units = F.regexp_count("whole", F.lit("[A-Za-z]+|[^A-Za-z]")).cast("bigint")
    counted = source.select("doc_id", "whole", units.alias("n"), form.alias("form"))
    one, other = first % (F.col("n") + 1), second % (F.col("n") + 1)
    cut = counted.select("*", F.least(one, other).alias("a"), F.greatest(one, other).alias("b"))
    pattern = _cut_pattern(F.col("a"), F.col("b") - F.col("a"))
    order_text = F.when(F.col("form") == "psm", PSM).otherwise(SPM)
    written = F.when(F.col("form") == "plain", F.col("whole")).otherwise(
        F.regexp_replace(F.col("whole"), pattern, order_text)
    )
    out = cut.select("doc_id", "n", "form", written.alias("output"))

    def place(mark: str) -> Column:
        return F.locate(mark, F.col("output"))

    prefix = F.when(F.col("form") == "psm", place(SUFFIX) - 4).when(F.col("form") == "spm", place(MIDDLE) - place(PREFIX) - 3)
    middle = F.when(F.col("form") != "plain", F.length("output") - place(MIDDLE) - 2)
    return out.select(
        "doc_id",
        "n",
        "form",
        prefix.cast("bigint").alias("prefix_chars"),
        middle.cast("bigint").alias("middle_chars"),
        "output",
    )


def digests(made: DataFrame) -> DataFrame:
    """The output and the text rebuilt from it, as digests."""
    again = restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(again.cast("binary"), 256).alias("restored_sha256"),
    )
