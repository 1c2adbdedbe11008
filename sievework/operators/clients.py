"""Infrastructure set up again and again: shared clients and request wrappers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..rules import (
    CLIENT_PATTERN,
    SPRAWL_FILES,
    SPRAWL_PROJECTS,
    SPRAWL_SHOWN,
    SPRAWL_TOTAL,
    WRAPPER_LINEAR,
    WRAPPER_PROJECTS,
    WRAPPER_TOTAL,
    java_pattern,
    needle_parts,
)
from ..schema import fact, facts_when, findings, no_facts

CHECK = "architecture_review"
CLIENT_NEEDLES = ("createclient", "createserverclient", "createbrowserclient", "@supabase")
WRAPPER_NEEDLES = ("fetch", "request", "api", "http")


def _mentions(text: Column, needles) -> Column:
    # In a list of one, as the text would be lowered for each needle else.
    return F.exists(F.array(F.lower(text)), lambda t: _any_of(t, needles))


def _any_of(text: Column, needles) -> Column:
    test = F.lit(False)
    for needle in needles:
        held = F.lit(True)
        for part in needle_parts(needle):
            held = held & F.contains(text, F.lit(part))
        test = test | held
    return test


def mentions_client(lowered: Column) -> Column:
    return _any_of(lowered, CLIENT_NEEDLES)


def mentions_wrapper(lowered: Column) -> Column:
    """Every wrapper's pattern ends in a parenthesis, besides its name."""
    return F.contains(lowered, F.lit("(")) & _any_of(lowered, WRAPPER_NEEDLES)


def sets_up_client(text: Column, pattern: str = CLIENT_PATTERN, mentioned: Column | None = None) -> Column:
    """``mentioned`` is :func:`mentions_client` where the text has been lowered already."""
    found = text.rlike(java_pattern(pattern))
    if pattern != CLIENT_PATTERN:
        return found
    return (_mentions(text, CLIENT_NEEDLES) if mentioned is None else mentioned) & found


def client_facts(text: Column, pattern: str = CLIENT_PATTERN, mentioned: Column | None = None) -> Column:
    return facts_when(sets_up_client(text, pattern, mentioned), F.array(fact(kind="client")))


def wrapper_facts(text: Column, mentioned: Column | None = None) -> Column:
    names = F.regexp_extract_all(text, F.lit(java_pattern(WRAPPER_LINEAR)), F.lit(1))
    if mentioned is None:
        mentioned = F.contains(text, F.lit("(")) & _mentions(text, WRAPPER_NEEDLES)
    return F.when(mentioned, F.transform(names, lambda n: fact(kind="wrapper", name=n))).otherwise(no_facts())


def client_files(files: DataFrame, pattern: str = CLIENT_PATTERN) -> DataFrame:
    """Files (project, path) that set up a client."""
    return files.where(sets_up_client(F.col("content"), pattern)).select("project", "path")


def clients_per_project(clients: DataFrame, show: int = SPRAWL_SHOWN) -> DataFrame:
    """Per project the number of files and the first few paths.

    The first paths come from a window with a rank limit, which keeps at most
    ``show`` rows per project and task before anything moves.
    """
    totals = clients.groupBy("project").agg(F.count(F.lit(1)).alias("n_files"))
    order = W.partitionBy("project").orderBy("path")
    first = (
        clients.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= show)
        .groupBy("project")
        .agg(F.array_sort(F.collect_list("path")).alias("shown"))
    )
    return totals.join(first, "project")


def sprawl_findings(per_project: DataFrame, min_files: int = SPRAWL_FILES, show: int = SPRAWL_SHOWN) -> DataFrame:
    n = F.col("n_files")
    return findings(
        per_project.where(n > min_files),
        check=CHECK,
        severity="info",
        file=F.col("project"),
        message=F.concat(
            F.lit("Supabase client initialized in "),
            n.cast("string"),
            F.lit(" files -- consider a shared client module. Files: "),
            F.array_join("shown", ", "),
            F.when(n > show, F.lit("...")).otherwise(F.lit("")),
        ),
    )


def sprawl(
    files: DataFrame, pattern: str = CLIENT_PATTERN, min_files: int = SPRAWL_FILES, show: int = SPRAWL_SHOWN
) -> DataFrame:
    """Projects that set up the same client in more than ``min_files`` files."""
    return sprawl_findings(clients_per_project(client_files(files, pattern), show), min_files, show)


def sprawl_global(
    clients: DataFrame, min_total: int = SPRAWL_TOTAL, min_projects: int = SPRAWL_PROJECTS
) -> DataFrame:
    """One finding when many files across projects set up the client.

    ``clients`` holds one row per file, or is already counted (project, n_files); the
    counts per project are the rows of :func:`clients_per_project`.
    """
    counts = clients
    if "n_files" not in clients.columns:
        counts = clients.groupBy("project").agg(F.count(F.lit(1)).alias("n_files"))
    total = counts.agg(F.sum("n_files").alias("total"), F.count(F.lit(1)).alias("projects")).where(
        (F.col("total") > min_total) & (F.col("projects") > min_projects)
    )
    return findings(
        total,
        check=CHECK,
        project=F.lit(None),
        severity="warning",
        file="(cross-project)",
        message=F.concat(
            F.lit("Supabase client initialized in "),
            F.col("total").cast("string"),
            F.lit(" files across "),
            F.col("projects").cast("string"),
            F.lit(" projects -- consider a shared client package"),
        ),
    )


def wrappers(files: DataFrame) -> DataFrame:
    """Functions named like request wrappers: (project, path, name), every match."""
    rows = files.select("project", "path", F.inline(wrapper_facts(F.col("content"))))
    return rows.select("project", "path", "name")


def wrapper_global(
    found: DataFrame, min_total: int = WRAPPER_TOTAL, min_projects: int = WRAPPER_PROJECTS
) -> DataFrame:
    """One finding when there are many wrappers in several projects."""
    total = (
        found.groupBy("project")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("projects"))
        .where((F.col("total") > min_total) & (F.col("projects") > min_projects))
    )
    return findings(
        total,
        check=CHECK,
        project=F.lit(None),
        severity="info",
        file="(cross-project)",
        message=F.concat(
            F.lit("Found "),
            F.col("total").cast("string"),
            F.lit(" HTTP fetch wrappers across "),
            F.col("projects").cast("string"),
            F.lit(" projects -- consider a shared fetch utility"),
        ),
    )
