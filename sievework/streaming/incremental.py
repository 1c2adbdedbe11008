"""The nightly rescan as a stream: only new and changed files are read.

Each micro-batch goes through the same single-pass extraction as a full audit and
leaves its facts in a table. Groups of equal functions, the one result that compares
everything with everything, are kept as a state per fingerprint that merges:

- A batch adds one small state per fingerprint of its own files, whatever was seen before.
- Files that an earlier batch had in another version are looked up in buckets of paths.
  The fingerprints of their old versions are counted again, from buckets of fingerprints,
  and the batch resets these states.
- The groups so far are the states since each fingerprint's last reset, merged.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.duplicates import FUNCTION_COLUMNS, functions_from, group_states, merged_states, repeated
from ..plans.audit import AuditInputs, audit, extract_facts
from ..plans.scale import small_side, stage
from ..rules import PROJECT_CHECKS
from ..schema import FACT_TYPES

FACTS_SCHEMA = "project string, path string, " + ", ".join(f"{n} {t}" for n, t in FACT_TYPES.items()) + ", batch bigint"
SEEN_SCHEMA = "project string, path string, size bigint, mtime timestamp, batch bigint, bucket int"
SITES_SCHEMA = "project string, path string, name string, line int, fp string, n_lines int, batch bigint, bucket int"
GONE_SCHEMA = "project string, path string, old bigint, batch bigint"
_PLACE = "struct<project:string,path:string>"
STATES_SCHEMA = (
    f"fp string, n bigint, low {_PLACE}, high {_PLACE}, "
    "site struct<project:string,path:string,line:int,name:string,n_lines:int>, reset boolean, batch bigint"
)
BUCKETS = 64


def _bucket(*columns: str):
    return F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)).cast("int")


def _table(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}")


def _current_sites(spark: SparkSession, folder: str, keys: DataFrame, upto: int, removed: DataFrame | None = None) -> DataFrame:
    """Functions with one of the fingerprints in files' newest versions; only its buckets are read."""
    sites = _table(spark, folder, "functions", SITES_SCHEMA).where(F.col("batch") <= upto)
    sites = sites.join(small_side(keys.select("bucket", "fp")), ["bucket", "fp"], "left_semi")
    gone = _table(spark, folder, "gone", GONE_SCHEMA).where(F.col("batch") <= upto)
    gone = gone.select("project", "path", F.col("old").alias("batch"))
    if removed is not None:
        gone = gone.unionByName(removed.select("project", "path", "batch"))
    return sites.join(gone.distinct(), ["project", "path", "batch"], "left_anti")


def _sites_of(spark: SparkSession, folder: str, versions: DataFrame) -> DataFrame:
    """Fingerprints (bucket, fp) that the given versions of files hold."""
    sites = _table(spark, folder, "functions", SITES_SCHEMA)
    return sites.join(small_side(versions.select("project", "path", "batch")), ["project", "path", "batch"], "left_semi").select(
        "bucket", "fp"
    ).distinct()


def update_groups(spark: SparkSession, folder: str, number: int, batch: DataFrame) -> None:
    """Write the states of one batch, whose facts and files are already written."""
    facts = _table(spark, folder, f"facts/batch={number}", FACTS_SCHEMA.replace(", batch bigint", ""))
    own = functions_from(facts).select(*FUNCTION_COLUMNS, _bucket("fp").alias("bucket"))
    own.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/functions/batch={number}")

    paths = batch.select("project", "path", _bucket("project", "path").alias("bucket")).distinct()
    # At most BUCKETS numbers.
    buckets = [r.bucket for r in paths.select("bucket").distinct().collect()]
    seen = _table(spark, folder, "files", SEEN_SCHEMA).where((F.col("batch") < number) & F.col("bucket").isin(buckets))
    before = seen.join(small_side(paths.select("project", "path")), ["project", "path"], "left_semi")
    before = before.groupBy("project", "path").agg(F.max("batch").alias("old"))
    before.write.mode("overwrite").parquet(f"{folder}/gone/batch={number}")
    replaced = spark.read.schema("project string, path string, old bigint").parquet(f"{folder}/gone/batch={number}")

    fresh = group_states(own).withColumn("reset", F.lit(False))
    if not replaced.isEmpty():
        keys = stage(_sites_of(spark, folder, replaced.withColumnRenamed("old", "batch")), "replaced")
        again = group_states(_current_sites(spark, folder, keys, number))
        counted = keys.select("fp").join(again, "fp", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        fresh = fresh.join(keys.select("fp"), "fp", "left_anti").unionByName(counted.withColumn("reset", F.lit(True)))
    fresh.write.mode("overwrite").parquet(f"{folder}/groups/batch={number}")


def groups_so_far(spark: SparkSession, folder: str, removed: DataFrame | None = None) -> DataFrame:
    """The duplicate groups of all files' newest versions, from the states.

    ``removed`` (project, path, batch) are newest versions of files that are gone; only
    the fingerprints in them are counted again.
    """
    states = _table(spark, folder, "groups", STATES_SCHEMA)
    resets = states.where("reset").groupBy("fp").agg(F.max("batch").alias("since"))
    valid = states.join(small_side(resets), "fp", "left").where("since IS NULL OR batch >= since")
    merged = merged_states(valid.select("fp", "n", "low", "high", "site"))
    if removed is not None and not removed.isEmpty():
        keys = stage(_sites_of(spark, folder, removed), "removed")
        last = _table(spark, folder, "groups", STATES_SCHEMA).agg(F.max("batch")).first()[0]
        again = group_states(_current_sites(spark, folder, keys, last, removed))
        merged = merged.join(keys.select("fp"), "fp", "left_anti").unionByName(again)
    return repeated(merged)


def audit_stream(
    stream: DataFrame,
    inputs: AuditInputs,
    folder: str,
    checkpoint: str,
    checks: Sequence[str] = tuple(PROJECT_CHECKS),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Extract facts from every new row of a streaming files table into ``folder``.

    A batch writes to a place of its own and replaces it when it is repeated, so a
    restart after a failure neither loses nor doubles facts.
    """

    def extract(batch: DataFrame, number: int) -> None:
        facts = extract_facts(replace(inputs, files=batch), checks)
        by_kind = facts.hint("rebalance", F.col("kind"))
        by_kind.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/facts/batch={number}")
        seen = batch.select("project", "path", "size", "mtime", _bucket("project", "path").alias("bucket"))
        seen.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/files/batch={number}")
        if "duplicate_code" in checks:
            update_groups(batch.sparkSession, folder, number, batch)

    return (
        stream.writeStream.foreachBatch(extract)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def latest_files(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version of every file seen so far, without text."""
    newest = _table(spark, folder, "files", SEEN_SCHEMA).groupBy("project", "path").agg(
        F.max_by(F.struct("size", "mtime", "batch"), "batch").alias("v")
    )
    return newest.select("project", "path", "v.size", "v.mtime", "v.batch")


def latest_facts(spark: SparkSession, folder: str, functions: bool = True) -> DataFrame:
    """Facts of the newest version of every file, on wish without the functions."""
    facts = _table(spark, folder, "facts", FACTS_SCHEMA)
    if not functions:
        facts = facts.where("kind <> 'function'")
    current = latest_files(spark, folder).select("project", "path", "batch")
    return facts.join(current, ["project", "path", "batch"], "left_semi").drop("batch")


def audit_so_far(
    spark: SparkSession,
    inputs: AuditInputs,
    folder: str,
    project: str | None = None,
    check: str | None = None,
    listing: DataFrame | None = None,
) -> DataFrame:
    """All findings over everything the stream has seen, as of ``inputs.as_of``.

    ``listing`` (project, path) names the files that exist now; others are forgotten, as
    a stream of new files never tells of removed ones. Duplicate groups come from their
    states, but for one project's own audit.
    """
    latest = latest_files(spark, folder)
    facts = latest_facts(spark, folder, functions=project is not None)
    removed = None
    if listing is not None:
        here = listing.select("project", "path").distinct()
        removed = stage(latest.join(here, ["project", "path"], "left_anti").select("project", "path", "batch"), "removed-files")
        latest = latest.join(here, ["project", "path"], "left_semi")
        facts = facts.join(here, ["project", "path"], "left_semi")
    files = latest.withColumn("content", F.lit(None).cast("string")).drop("batch")
    groups = None
    if project is None and check in (None, "duplicate_code"):
        groups = groups_so_far(spark, folder, removed)
    return audit(replace(inputs, files=files, facts=facts, groups=groups), project, check)
