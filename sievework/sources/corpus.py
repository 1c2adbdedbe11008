"""Directory trees as a files table, with the work shared out by entries and bytes.

The built-in file sources hide names that start with ``.`` or ``_`` and skip empty
files, both of which an audit needs, so tasks walk the directories themselves, in three
Spark steps that no project, however large, turns into one task:

1. Folders are opened in rounds. A task walks until it has seen ``OPEN_ENTRIES`` entries
   and hands the folders it has not opened back as rows, which the next round deals out.
2. Names are dealt out evenly, and sizes and times are looked up.
3. A prefix sum of the sizes cuts the listing into parts of equal bytes; each task opens
   the files of its own part.
"""

from __future__ import annotations

import datetime
import fnmatch
import os
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.scale import small_side, stage
from ..schema import FILES

OPEN_ENTRIES = 20_000
BATCH_BYTES = 16 * 1024 * 1024
PART_BYTES = 128 * 1024 * 1024
# What opening a file costs beside its bytes.
FILE_COST = 4096
# Neither a Spark string nor an Arrow one can hold more.
STRING_BYTES = (1 << 31) - (1 << 16)

# kind: root (a project's folder that exists), folder (still to open) or file.
ENTRIES = "kind string, project string, root string, globs array<string>, path string"
LISTED = "project string, root string, path string, size bigint, mtime timestamp"
_ENTRIES = pa.schema(
    [("kind", pa.string()), ("project", pa.string()), ("root", pa.string()), ("globs", pa.list_(pa.string())), ("path", pa.string())]
)
_LISTED = pa.schema(
    [("project", pa.string()), ("root", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("mtime", pa.timestamp("us", tz="UTC"))]
)
_FILES = pa.schema(
    [("project", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("mtime", pa.timestamp("us", tz="UTC")), ("content", pa.string())]
)


@dataclass(frozen=True)
class Corpus:
    """The files of a corpus, and the names of the projects whose folder exists."""

    files: DataFrame
    roots: DataFrame


def _pruned(relative: str, globs: Sequence[str]) -> bool:
    parts = [p for p in relative.split("/") if p not in ("", ".")]
    return any(fnmatch.fnmatchcase(relative, g) or any(fnmatch.fnmatchcase(p, g) for p in parts) for g in globs)


def _full(root: str, path: str) -> str:
    return os.path.join(root, path) if path else root


def _opened(root: str, folder: str, globs: Sequence[str]) -> Iterator[tuple[str, str]]:
    """(kind, path) of what a folder holds; folders that a glob ignores are left out."""
    try:
        with os.scandir(_full(root, folder)) as entries:
            for entry in entries:
                path = f"{folder}/{entry.name}" if folder else entry.name
                if entry.is_dir(follow_symlinks=False):
                    # A directory in the root is tested as "./name", deeper ones as "a/name".
                    if not _pruned(f"{folder or '.'}/{entry.name}", globs):
                        yield "folder", path
                elif entry.is_file():
                    yield "file", path
    except OSError:
        return


def _walk(limit: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                root, globs = row["root"], [g for g in row["globs"] or [] if g is not None]
                first = row["kind"] == "project"
                if first:
                    root = os.path.realpath(os.path.expanduser(root)) if root else ""
                    if not root or not os.path.isdir(root):
                        continue
                    found.append(("root", row["project"], root, None, ""))
                folders = ["" if first else row["path"]]
                while folders and seen < limit:
                    for kind, path in _opened(root, folders.pop(), globs):
                        seen += 1
                        if kind == "folder":
                            folders.append(path)
                        else:
                            found.append((kind, row["project"], root, None, path))
                        if len(found) >= limit:
                            yield _batch(found, _ENTRIES)
                            found = []
                found += [("folder", row["project"], root, globs, path) for path in folders]
            if found:
                yield _batch(found, _ENTRIES)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            try:
                stat = os.stat(_full(row["root"], row["path"]))
            except OSError:
                continue
            mtime = datetime.datetime.fromtimestamp(stat.st_mtime, datetime.timezone.utc)
            rows.append((row["project"], row["root"], row["path"], stat.st_size, mtime))
        if rows:
            yield _batch(rows, _LISTED)


def _read(max_size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for row in batch.to_pylist():
                if rows and held + row["size"] > BATCH_BYTES:
                    yield _batch(rows, _FILES)
                    rows, held = [], 0
                text = None
                if row["size"] <= max_size:
                    try:
                        with open(_full(row["root"], row["path"]), "rb") as handle:
                            text = handle.read().decode("utf-8", "ignore")
                    except OSError:
                        pass
                rows.append((row["project"], row["path"], row["size"], row["mtime"], text))
                held += len(text or "") + 200
            if rows:
                yield _batch(rows, _FILES)

    return run


def list_corpus(spark: SparkSession, projects: DataFrame, limit: int = OPEN_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """(listing, roots): every file's size and time without its text, and the roots found.

    As many rounds as the deepest chain of full tasks needs; each round is a table.
    """
    cores = spark.sparkContext.defaultParallelism
    todo = projects.select(
        F.lit("project").alias("kind"),
        F.col("name").alias("project"),
        F.col("path").alias("root"),
        F.col("ignore_patterns").cast("array<string>").alias("globs"),
        F.lit("").alias("path"),
    )
    rounds = []
    while True:
        done = stage(todo.repartition(4 * cores).mapInArrow(_walk(limit), ENTRIES), "corpus-round")
        rounds.append(done)
        todo = done.where("kind = 'folder'")
        if todo.isEmpty():
            break
    every = rounds[0]
    for one in rounds[1:]:
        every = every.unionByName(one)
    names = every.where("kind = 'file'").select("project", "root", "path").repartition(4 * cores)
    listing = stage(names.mapInArrow(_looked_up, LISTED).withColumn("task", F.spark_partition_id()), "corpus-listing")
    return listing, every.where("kind = 'root'").select(F.col("project").alias("name"))


def byte_parts(listing: DataFrame, parts: int | None = None) -> tuple[DataFrame, int]:
    """The listing with a ``part`` of about equal bytes for each file, and the number of parts.

    The prefix sum is taken inside each task's share of the listing and shifted by the
    shares before it, of which there is one row each.
    """
    spark = listing.sparkSession
    cost = F.col("size") + FILE_COST
    shares = listing.groupBy("task").agg(F.sum(cost).alias("bytes"))
    total = shares.agg(F.sum("bytes")).first()[0] or 0
    parts = parts or max(spark.sparkContext.defaultParallelism, -(-total // PART_BYTES))
    shift = F.sum("bytes").over(Window.orderBy("task")) - F.col("bytes")
    shifts = shares.select(F.col("task").alias("of"), shift.alias("shift"))
    inside = Window.partitionBy("task").orderBy("project", "path")
    placed = listing.withColumn("at", F.sum(cost).over(inside) - cost)
    joined = placed.join(small_side(shifts), F.col("task") == F.col("of"))
    part = F.least(F.floor((F.col("at") + F.col("shift")) * parts / max(total, 1)), F.lit(parts - 1)).cast("int")
    return joined.select("project", "root", "path", "size", "mtime", part.alias("part")), parts


def scan_corpus(
    spark: SparkSession,
    projects: DataFrame | Sequence[dict],
    max_size: int | None = None,
    read_content: bool = True,
    parts: int | None = None,
    limit: int = OPEN_ENTRIES,
) -> Corpus:
    """The files below the projects' folders, and which of the folders exist.

    ``projects`` has name, path and ignore_patterns, any number of rows. The paths must be
    visible to all executors. Files of any size are read, unless ``max_size`` is set;
    content is NULL beyond it, beyond the 2 GB of a Spark string, where a file can't be
    read, and everywhere with ``read_content=False``. A missing folder gives no rows,
    linked folders are not followed.
    """
    if not isinstance(projects, DataFrame):
        rows = [(p["name"], p.get("path"), list(p.get("ignore_patterns") or [])) for p in projects]
        projects = spark.createDataFrame(rows, "name string, path string, ignore_patterns array<string>")
    listing, roots = list_corpus(spark, projects, limit)
    if not read_content:
        content = F.lit(None).cast("string").alias("content")
        return Corpus(listing.select("project", "path", "size", "mtime", content), roots)
    placed, n = byte_parts(listing, parts)
    cap = STRING_BYTES if max_size is None else min(max_size, STRING_BYTES)
    dealt = placed.repartitionById(n, "part").drop("part")
    return Corpus(dealt.mapInArrow(_read(cap), FILES), roots)


def read_corpus(spark: SparkSession, projects: DataFrame | Sequence[dict], **options) -> DataFrame:
    """The files of :func:`scan_corpus` alone."""
    return scan_corpus(spark, projects, **options).files
