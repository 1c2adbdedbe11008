"""Age tiers and drift against a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import age_days
from ..rules import DRIFT_LABELS, DRIFT_MEAN, DRIFT_SINGLE, STALE_DAYS, VERY_STALE_DAYS
from ..schema import display_path, findings


def stale_severity(age: Column, warn_after: int = VERY_STALE_DAYS) -> Column:
    return F.when(age > warn_after, "warning").otherwise("info")


def stale_message(age: Column) -> Column:
    return F.concat(F.lit("Stale file: not modified in "), age.cast("bigint").cast("string"), F.lit(" days"))


def stale(
    files: DataFrame, as_of: Column, info_after: int = STALE_DAYS, warn_after: int = VERY_STALE_DAYS
) -> DataFrame:
    """Files older than a number of days; reads no content.

    The age test is written against ``mtime`` itself so that it reaches the scan.
    """
    cutoff = as_of - F.expr(f"INTERVAL {info_after} DAYS")
    old = files.where(F.col("mtime") < cutoff).withColumn("age", age_days("mtime", as_of))
    return findings(
        old,
        check="dead_code",
        severity=stale_severity(F.col("age"), warn_after),
        file=display_path(),
        message=stale_message(F.col("age")),
    )


def drift_rows(current: DataFrame, baseline: DataFrame, key: str, score: str, label: str) -> DataFrame:
    """Current and baseline score and label side by side, per key."""
    now = current.select(key, F.col(score).alias("score"), F.col(label).alias("label"))
    then = baseline.select(key, F.col(score).alias("base_score"), F.col(label).alias("base_label"))
    return now.join(then, key, "full_outer")


def drift(
    current: DataFrame,
    baseline: DataFrame,
    key: str,
    score: str,
    label: str,
    max_labels: float = DRIFT_LABELS,
    max_mean: float = DRIFT_MEAN,
    max_single: float = DRIFT_SINGLE,
) -> DataFrame:
    """One row: how far scores and labels moved, and whether that counts as drift.

    Keys on one side only are counted but not compared. Without any baseline row the
    status is ``no baseline``.
    """
    both = F.col("score").isNotNull() & F.col("base_score").isNotNull()
    change = F.col("score") - F.col("base_score")
    changed = both & (F.col("label") != F.col("base_label"))
    totals = drift_rows(current, baseline, key, score, label).agg(
        F.count_if(both).alias("compared"),
        F.count_if(F.col("base_score").isNotNull()).alias("baseline_rows"),
        F.count_if(changed).alias("changed_labels"),
        F.avg(F.when(both, change)).alias("mean_change"),
        F.max(F.when(both, F.abs(change))).alias("max_change"),
        F.count_if(both & (F.abs(change) > max_single)).alias("moved_keys"),
    )
    share = F.try_divide("changed_labels", "compared")
    moved = (share > max_labels) | (F.abs("mean_change") > max_mean) | (F.col("moved_keys") > 0)
    status = (
        F.when(F.col("baseline_rows") == 0, "no baseline")
        .when(F.coalesce(moved, F.lit(False)), "drift")
        .otherwise("stable")
    )
    return totals.withColumn("label_share", share).withColumn("status", status)
