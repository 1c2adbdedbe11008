"""What a project should contain and does not: entries, files, keys, indexes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..rules import (
    IGNORE_ALTERNATIVES,
    KEY_COLUMN_PATTERN,
    MIGRATION_DIRS,
    REQUIRED_IGNORE_ENTRIES,
    SPACE,
    TABLE_PATTERN,
    java_pattern,
)
from ..schema import FINDING_COLUMNS, display_path, fact, findings, no_facts

IGNORE_FILE = ".gitignore"


def root_files(files: DataFrame) -> DataFrame:
    """Files directly in a project's root, without their content."""
    return files.where(~F.contains("path", F.lit("/"))).select("project", "path", "size", "mtime")


def root_flags(files: DataFrame, names: dict[str, Sequence[str]], suffixes: dict[str, str] | None = None) -> DataFrame:
    """Per project, whether its root holds any of the named files; one aggregation for all.

    ``names`` maps a flag to file names, ``suffixes`` maps a flag to a file suffix.
    """
    tests = {flag: F.col("path").isin(list(n)) for flag, n in names.items()}
    tests.update({flag: F.col("path").endswith(s) for flag, s in (suffixes or {}).items()})
    relevant = F.lit(False)
    for test in tests.values():
        relevant = relevant | test
    rows = root_files(files).where(relevant)
    return rows.groupBy("project").agg(*[F.max(t).alias(flag) for flag, t in tests.items()])


def _flagged(files: DataFrame, projects: DataFrame, names, suffixes=None) -> DataFrame:
    flags = root_flags(files, names, suffixes)
    names_of = projects.select(F.col("name").alias("project"))
    return names_of.join(flags, "project", "left").na.fill(False)


def missing_entries(
    files: DataFrame,
    projects: DataFrame,
    required: Sequence[str] = tuple(REQUIRED_IGNORE_ENTRIES),
    alternatives: Sequence[str] = tuple(IGNORE_ALTERNATIVES),
) -> DataFrame:
    """Required lines that a project's ignore file lacks; one row if there is no file.

    A line counts as given when it stands alone or as ``*entry*``, or when one of
    the alternatives is there.
    """
    given = files.where(F.col("path") == IGNORE_FILE).select(
        "project", F.transform(F.split(F.coalesce("content", F.lit("")), "\n"), strip).alias("rows")
    )
    names_of = projects.select(F.col("name").alias("project"))
    joined = names_of.join(given, "project", "left")
    wanted = F.array(*[F.lit(r) for r in required])
    lacking = F.filter(
        wanted,
        lambda r: ~F.array_contains("rows", r)
        & ~F.array_contains("rows", F.concat(F.lit("*"), r, F.lit("*"))),
    )
    lacking = F.when(
        F.arrays_overlap("rows", F.array(*[F.lit(a) for a in alternatives])), F.array().cast("array<string>")
    ).otherwise(lacking)
    messages = F.when(
        F.col("rows").isNull(), F.array(F.lit("No .gitignore file found -- secrets may be committed"))
    ).otherwise(
        F.transform(lacking, lambda r: F.concat(r, F.lit(" not found in .gitignore -- secrets may be committed")))
    )
    return findings(
        joined.select("project", F.explode(messages).alias("text")),
        check="security_scan",
        severity="warning",
        file=F.concat_ws("/", "project", F.lit(IGNORE_FILE)),
        message=F.col("text"),
    )


def missing_counterpart(
    files: DataFrame, projects: DataFrame, present: str = ".env", absent: str = ".env.example"
) -> DataFrame:
    """Projects with one root file but not its companion."""
    flags = _flagged(files, projects, {"has": [present], "pair": [absent]})
    return findings(
        flags.where(F.col("has") & ~F.col("pair")),
        check="architecture_review",
        severity="info",
        file=F.concat_ws("/", "project", F.lit(absent)),
        message=f"Project has {present} but no {absent} -- new developers won't know required env vars",
    )


def missing_manifest(files: DataFrame, projects: DataFrame) -> DataFrame:
    """Projects with Python files in their root but neither kind of manifest."""
    flags = _flagged(files, projects, {"manifest": ["requirements.txt", "pyproject.toml"]}, {"python": ".py"})
    return findings(
        flags.where(F.col("python") & ~F.col("manifest")),
        check="dependency_audit",
        severity="info",
        file=F.concat_ws("/", "project", F.lit("requirements.txt")),
        message="Python project without requirements.txt or pyproject.toml",
    )


# --- foreign keys without an index -----------------------------------------


def migration_path(path: Column, dirs: Sequence[str] = tuple(MIGRATION_DIRS)) -> Column:
    """Path below a migration directory, NULL for other files."""
    inside = "|".join("\\Q" + d + "\\E" for d in dirs)
    return F.when(path.endswith(".sql"), F.nullif(F.regexp_extract(path, rf"\A(?:{inside})/(.+)\z", 1), F.lit("")))


def index_tails(text: Column) -> Column:
    """What follows each CREATE INDEX on its line, in lower case.

    White space after ON, CREATE and UNIQUE may hold line ends; it becomes one space.
    """
    joined = F.regexp_replace(text, rf"(?diu)(?<=ON|CREATE|UNIQUE)[{SPACE}]+", " ")
    tails = F.regexp_extract_all(joined, F.lit(r"(?diu)CREATE (?:UNIQUE )?INDEX([^\n]*)"), F.lit(1))
    return F.transform(tails, F.lower)


def unindexed_facts(text: Column) -> Column:
    """Foreign-key columns of a migration with no single-column index in the same file.

    Everything is inside one file, so this is an anti-join of two small lists there; names
    are compared as text and never become part of a pattern.
    """
    pattern = F.lit(java_pattern(TABLE_PATTERN))
    # Up to the last end of a table every head finds an end, so no search runs in vain.
    closed = F.regexp_extract(text, r"\A([\s\S]*\);)", 1)
    tables = F.arrays_zip(
        F.regexp_extract_all(closed, pattern, F.lit(1)).alias("name"),
        F.regexp_extract_all(closed, pattern, F.lit(2)).alias("body"),
    )
    keys = F.flatten(
        F.transform(
            tables,
            lambda t: F.transform(
                F.regexp_extract_all(t["body"], F.lit(java_pattern(KEY_COLUMN_PATTERN)), F.lit(1)),
                lambda c: F.struct(t["name"].alias("table"), c.alias("column")),
            ),
        )
    )

    def indexed(key: Column, indexes: Column) -> Column:
        table = F.concat(F.lit("on "), F.lower(key["table"]))
        column = F.concat(F.lit("("), F.lower(key["column"]), F.lit(")"))

        def covers(tail: Column) -> Column:
            at = F.position(table, tail)
            return (at > 0) & (F.position(column, tail, at + F.length(table)) > 0)

        return F.exists(indexes, covers)

    # In a list of one, as the indexes would be read from the text again for each key else.
    both = F.array(F.struct(keys.alias("keys"), index_tails(text).alias("indexes")))

    def unindexed(lists: Column) -> Column:
        return F.filter(lists["keys"], lambda k: ~indexed(k, lists["indexes"]))

    def lacking(key: Column) -> Column:
        message = F.concat(
            F.lit("Foreign key column '"),
            key["column"],
            F.lit("' in table '"),
            key["table"],
            F.lit("' has no index -- queries filtering on this will be slow"),
        )
        return fact(kind="finding", check="performance_lint", severity="warning", message=message)

    return F.when(
        closed.rlike(java_pattern(TABLE_PATTERN)), F.transform(F.flatten(F.transform(both, unindexed)), lacking)
    ).otherwise(no_facts())


def unindexed_fks(files: DataFrame, dirs: Sequence[str] = tuple(MIGRATION_DIRS)) -> DataFrame:
    sql = files.where(migration_path(F.col("path"), dirs).isNotNull())
    rows = sql.select("project", "path", F.inline(unindexed_facts(F.col("content"))))
    return rows.withColumn("file", display_path()).select(*FINDING_COLUMNS)
