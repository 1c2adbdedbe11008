"""Tables of text as files tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def files_from(
    table: DataFrame,
    project: str | Column,
    path: str | Column,
    content: str | Column,
    mtime: str | Column | None = None,
) -> DataFrame:
    """Any table with a source, an identifier and a text in the files layout."""

    def col(c):
        return F.col(c) if isinstance(c, str) else c

    stamp = col(mtime) if mtime is not None else F.lit(None)
    return table.select(
        col(project).cast("string").alias("project"),
        col(path).cast("string").alias("path"),
        F.octet_length(col(content)).cast("bigint").alias("size"),
        stamp.cast("timestamp").alias("mtime"),
        col(content).alias("content"),
    )


def spread_small(scan: DataFrame, *columns: str) -> DataFrame:
    """Share out a scan that has fewer splits than there are cores.

    That only happens on inputs of a few megabytes; a large scan has many splits
    and is returned as it is, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= 2 * cores:
        return scan
    return scan.repartition(2 * cores, *columns)


def write_tree(files: DataFrame, folder: str) -> int:
    """Write every row's content as ``folder/project/path``; the number of files.

    The folder must be one that all executors see. A file appears whole under its name,
    and a repeated task writes the same again; content NULL gives an empty file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                target = os.path.join(folder, row["project"], row["path"])
                os.makedirs(os.path.dirname(target), exist_ok=True)
                part = f"{target}.{uuid.uuid4().hex}.part"
                with open(part, "wb") as handle:
                    handle.write((row["content"] or "").encode())
                os.replace(part, target)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    written = files.select("project", "path", "content").mapInArrow(run, "n bigint")
    return written.agg(F.sum("n")).first()[0] or 0
