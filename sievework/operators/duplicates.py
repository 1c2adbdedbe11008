"""Functions of equal structure, within and across projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_fingerprint
from ..schema import FINDING_COLUMNS, fact, facts_when, findings
from .extract import js_facts, python_facts, small_batches

CHECK = "duplicate_code"
FUNCTION_COLUMNS = ["project", "path", "name", "line", "fp", "n_lines"]


def function_facts(found: Column) -> Column:
    """Facts from the ``functions`` list of the Python extraction."""
    return F.transform(
        found, lambda f: fact(kind="function", name=f["name"], line=f["line"], value=f["fp"], num=f["n_lines"])
    )


def block_facts(found: Column) -> Column:
    """Facts from the ``blocks`` list of the brace extraction; the shape is taken here."""
    return F.transform(
        found,
        lambda b: fact(
            kind="function", name=b["name"], line=b["line"], value=text_fingerprint(b["block"]), num=b["n_lines"]
        ),
    )


def functions_from(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("kind") == "function").select(
        "project", "path", "name", "line", F.col("value").alias("fp"), F.col("num").alias("n_lines")
    )


def py_functions(files: DataFrame) -> DataFrame:
    """Functions of Python files with a structural fingerprint."""
    small_batches(files.sparkSession)
    found = files.where(F.col("path").endswith(".py")).select(
        "project", "path", python_facts(F.col("content")).alias("py")
    )
    rows = found.select("project", "path", F.inline("py.functions"))
    return rows.select(*FUNCTION_COLUMNS)


def js_functions(files: DataFrame) -> DataFrame:
    """Named brace blocks of JavaScript and TypeScript files with a fingerprint."""
    small_batches(files.sparkSession)
    found = files.where(F.col("path").rlike(r"\.(?:js|mjs|cjs|ts|tsx)\z")).select(
        "project", "path", js_facts(F.col("content")).alias("js")
    )
    rows = found.select("project", "path", F.inline("js.blocks"))
    return rows.withColumn("fp", text_fingerprint("block")).select(*FUNCTION_COLUMNS)


def text_blocks(files: DataFrame) -> DataFrame:
    """Whole texts as if each were one function: duplicate documents by shape."""
    newlines = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit("")))
    return files.select(
        "project",
        "path",
        F.lit("text").alias("name"),
        F.lit(1).alias("line"),
        text_fingerprint("content").alias("fp"),
        newlines.cast("int").alias("n_lines"),
    )


def _site() -> Column:
    return F.struct("project", "path", "line", "name", "n_lines")


def group_states(functions: DataFrame) -> DataFrame:
    """What is kept of each fingerprint: fp, n, the smallest and largest place, the first site.

    States of parts of a corpus merge into the state of the whole. No group is gathered.
    """
    place = F.struct("project", "path")
    return functions.groupBy("fp").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(place).alias("low"),
        F.max(place).alias("high"),
        F.min(_site()).alias("site"),
    )


def merged_states(states: DataFrame) -> DataFrame:
    return states.groupBy("fp").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("site").alias("site")
    )


def repeated(states: DataFrame) -> DataFrame:
    """The groups among the states: fp, n, cross_project and the first site.

    Two copies make a group; copies inside one file need to be three. Whether a group
    spans files or projects is read off the smallest and largest place.
    """
    spread = F.col("low") != F.col("high")
    return states.where((F.col("n") >= 3) | ((F.col("n") == 2) & spread)).select(
        "fp", "n", (F.col("low.project") != F.col("high.project")).alias("cross_project"), "site"
    )


def duplicate_groups(functions: DataFrame) -> DataFrame:
    """Groups of equal fingerprints; their members are the rows of :func:`duplicate_sites`."""
    return repeated(group_states(functions))


def duplicate_sites(functions: DataFrame, groups: DataFrame) -> DataFrame:
    """Every member of every group, one row each, however large the group.

    The join has no aggregation after it, so a hot fingerprint is split at run time.
    """
    return functions.join(groups.select("fp", F.col("n").alias("copies"), "cross_project"), "fp")


def duplicate_findings(groups: DataFrame) -> DataFrame:
    """One finding per group, at its first site; the others are duplicate sites."""
    first = F.format_string(
        "%s/%s:%d -> %s() (%d lines)",
        *[F.col(f"site.{c}") for c in ("project", "path", "line", "name", "n_lines")],
    )
    return findings(
        groups,
        check=CHECK,
        project=F.lit(None),
        severity=F.when(F.col("cross_project"), "warning").otherwise("info"),
        file=F.concat_ws("/", "site.project", "site.path"),
        line=F.col("site.line"),
        message=F.concat(
            F.lit("Duplicate function structure found in "),
            F.col("n").cast("string"),
            F.lit(" locations"),
            F.when(F.col("cross_project"), F.lit(" (CROSS-PROJECT)")).otherwise(F.lit("")),
            F.lit(", first: "),
            first,
        ),
    ).select(*FINDING_COLUMNS)


def extraction_errors(error: Column, check: str) -> Column:
    """A warning fact for a file whose extraction failed."""
    message = F.concat(F.lit("Check failed with error: "), error)
    return facts_when(
        error.isNotNull(), F.array(fact(kind="finding", check=check, severity="warning", message=message))
    )
