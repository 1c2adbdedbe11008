"""From findings to reports: roll-ups, top lists, gate, text and files."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import FINDING_COLUMNS, SEVERITIES
from .scale import small_side

ORDER = ["project", "file", "line", "check", "message"]


def _zero_filled(prefix: str = "") -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(prefix + s) for s in SEVERITIES]


def project_summary(findings: DataFrame, projects: DataFrame) -> DataFrame:
    """Totals and counts by severity for every scanned project, clean ones included."""
    counts = (
        findings.where(F.col("project").isNotNull())
        .groupBy("project")
        .agg(F.count(F.lit(1)).alias("total"), *_zero_filled())
    )
    names = projects.select(F.col("name").alias("project"))
    return names.join(counts, "project", "left").na.fill(0)


def report_totals(findings: DataFrame, projects: DataFrame) -> DataFrame:
    """One row over all findings, those between projects included."""
    scanned = projects.agg(F.count(F.lit(1)).alias("projects_scanned")).withColumn("one", F.lit(1))
    totals = findings.agg(F.count(F.lit(1)).alias("total"), *_zero_filled()).withColumn("one", F.lit(1))
    return scanned.join(totals, "one").drop("one")


def check_counts(findings: DataFrame) -> DataFrame:
    rows = findings.where(F.col("project").isNotNull())
    return rows.groupBy("project", "check").agg(F.count(F.lit(1)).alias("total"))


def status(summary: DataFrame) -> DataFrame:
    ladder = (
        F.when(F.col("total") == 0, "CLEAN")
        .when(F.col("critical") > 0, "CRITICAL")
        .when(F.col("warning") > 0, "WARNINGS")
        .otherwise("INFO")
    )
    return summary.withColumn("status", ladder)


def gate(findings: DataFrame) -> DataFrame:
    """One row: ``failed`` is true when there is any critical finding."""
    critical = F.coalesce(F.bool_or(F.col("severity") == "critical"), F.lit(False))
    return findings.agg(critical.alias("failed"))


def head_findings(findings: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` findings per project and check, and how many more there are.

    The rank limit is applied in every task before rows move; the totals come from
    an aggregation, not from the window, so one large group is never sorted whole.
    """
    rows = findings.where(F.col("project").isNotNull())
    order = W.partitionBy("project", "check").orderBy("file", "line", "message", "snippet", "severity")
    first = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return first.join(check_counts(findings), ["project", "check"]).select(
        "project",
        "check",
        "rank",
        "severity",
        "file",
        "line",
        "message",
        F.greatest(F.col("total") - n, F.lit(0)).alias("more"),
    )


def critical_top(findings: DataFrame, k: int = 10) -> DataFrame:
    """The first ``k`` critical findings in a fixed order, with the overflow count."""
    critical = findings.where(F.col("severity") == "critical")
    top = critical.orderBy(*ORDER).limit(k).withColumn("one", F.lit(1))
    total = critical.agg(F.count(F.lit(1)).alias("total")).withColumn("one", F.lit(1))
    return top.join(total, "one").select(
        *ORDER, "severity", F.greatest(F.col("total") - k, F.lit(0)).alias("more")
    )


def _critical_lines(findings: DataFrame, k: int, cut: int, lead: str) -> DataFrame:
    """The top rows as text, numbered in order. At most ``k`` rows are windowed."""
    top = findings.where(F.col("severity") == "critical").orderBy(*ORDER).limit(k)
    rank = F.row_number().over(W.orderBy(*ORDER))
    return top.select(
        rank.alias("pos"),
        F.concat(
            F.lit(f"{lead}- ["), "check", F.lit("] "), "file", F.lit(": "), F.left("message", F.lit(cut))
        ).alias("text"),
    )


def _section(rows: DataFrame, section: int) -> DataFrame:
    return rows.select(
        F.lit(section).alias("section"), F.col("pos").cast("bigint").alias("pos"), F.col("text")
    )


def alert_lines(findings: DataFrame, run_date: str, report_path: str = "/tmp", k: int = 10) -> DataFrame:
    """Alert text as ordered rows (section, pos, text); no rows without critical findings."""
    n = F.col("n").cast("string")
    total = findings.agg(F.count_if(F.col("severity") == "critical").alias("n")).where(F.col("n") > 0)
    zero = F.lit(0).alias("pos")
    head = total.select(
        zero, F.concat(F.lit("QA ALERT: "), n, F.lit(f" critical issues found ({run_date})")).alias("text")
    )
    blank = total.select(zero, F.lit("").alias("text"))
    more = total.where(F.col("n") > k).select(
        zero, F.concat(F.lit("... and "), (F.col("n") - k).cast("string"), F.lit(" more")).alias("text")
    )
    path = total.select(zero, F.lit(f"\nFull report: {report_path}/qa-report-{run_date}.json").alias("text"))
    parts = [head, blank, _critical_lines(findings, k, 100, ""), more, path]
    out = _section(parts[0], 0)
    for i, part in enumerate(parts[1:], 1):
        out = out.unionByName(_section(part, i))
    return out


def digest_lines(
    findings: DataFrame, summary: DataFrame, totals: DataFrame, run_date: str, duration: float = 0.0, k: int = 5
) -> DataFrame:
    """Digest text as ordered rows: totals, projects with problems, top critical findings."""

    def text_of(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p[0].cast("string") for p in parts]).alias("text")

    def c(name: str) -> list[Column]:
        return [F.col(name)]

    zero = F.lit(0).alias("pos")
    head = totals.select(zero, F.lit(f"Nightly audit report — {run_date}").alias("text"))
    counts = totals.select(
        zero,
        text_of(
            "Projects: ", c("projects_scanned"), " | Findings: ", c("total"),
            " (critical=", c("critical"), ", warning=", c("warning"), ", info=", c("info"), ")",
        ),
    )
    lasted = totals.select(zero, F.lit(f"Duration: {duration}s").alias("text"))
    # The project is its own sort key; numbering all projects would need one task.
    problems = summary.where((F.col("critical") > 0) | (F.col("warning") > 0)).select(
        zero,
        text_of("  ", c("project"), ": ", c("critical"), " critical, ", c("warning"), " warning, ", c("info"), " info"),
    )
    title = totals.where(F.col("critical") > 0).select(zero, F.lit("Critical issues:").alias("text"))
    parts = [head, counts, lasted, problems, title, _critical_lines(findings, k, 120, "  ")]
    out = _section(parts[0], 0)
    for i, part in enumerate(parts[1:], 1):
        out = out.unionByName(_section(part, i))
    return out


# --- sinks -----------------------------------------------------------------


def write_report(findings: DataFrame, projects: DataFrame, folder: str, run_date: str, fmt: str = "json") -> str:
    """Write one run's findings, totals and summary; the name of the run.

    Totals and summary are counted from the findings as written. A run has folders of its
    own, and a row in ``commits`` written last makes it the run of its day: until then
    readers see the day's former run whole, and a run that fails is never seen.
    """
    spark = findings.sparkSession
    run = uuid.uuid4().hex

    def place(name: str) -> str:
        return f"{folder}/{name}/run_date={run_date}/run={run}"

    findings.write.format(fmt).save(place("findings"))
    written = spark.read.format(fmt).schema(findings.schema).load(place("findings"))
    report_totals(written, projects).write.format(fmt).save(place("totals"))
    project_summary(written, projects).write.format(fmt).save(place("summary"))
    # One small row for each run; the later of two equal times is the one with the larger name.
    row = spark.range(1).select(F.lit(run_date).alias("day"), F.lit(run).alias("name"), F.lit(time.time_ns()).alias("at"))
    row.coalesce(1).write.mode("append").parquet(f"{folder}/commits")
    return run


def read_report(spark: SparkSession, folder: str, name: str = "findings", fmt: str = "json") -> DataFrame:
    """What the last committed run of every day wrote: findings, totals or summary, with ``run_date``."""
    commits = spark.read.schema("day string, name string, at bigint").parquet(f"{folder}/commits")
    current = commits.groupBy("day").agg(F.max_by("name", F.struct("at", "name")).alias("name"))
    schema = {
        "findings": ", ".join(f"`{c}` {'int' if c == 'line' else 'string'}" for c in FINDING_COLUMNS),
        "totals": "projects_scanned bigint, total bigint, " + ", ".join(f"{s} bigint" for s in SEVERITIES),
        "summary": "project string, total bigint, " + ", ".join(f"{s} bigint" for s in SEVERITIES),
    }[name]
    rows = spark.read.format(fmt).schema(f"{schema}, run_date string, run string").load(f"{folder}/{name}")
    same = (F.col("run_date") == F.col("day")) & (F.col("run") == F.col("name"))
    return rows.join(small_side(current), same, "left_semi").drop("run")


def write_alert(findings: DataFrame, path: str, run_date: str, report_path: str = "/tmp") -> str | None:
    """Write the alert text if there is anything critical; otherwise leave old files alone."""
    rows = alert_lines(findings, run_date, report_path)
    if rows.isEmpty():
        return None
    # Thirteen rows at most, so one file keeps them in order.
    rows.orderBy("section", "pos").coalesce(1).select("text").write.mode("overwrite").text(path)
    return path


def write_digest(lines: DataFrame, path: str) -> str:
    lines.orderBy("section", "pos", "text").select("text").write.mode("overwrite").text(path)
    return path
