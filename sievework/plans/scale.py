"""Means that keep plans sound when tables, keys or groups are very large."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
SALTS = 8
# A table is only broadcast after it was found to have no more rows than this.
SMALL_ROWS = 200_000
# Bits of the map that stands for a set of keys: 16 MB when every part of it is used.
KEY_BITS = 1 << 27


def small_side(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Broadcast a dimension table after counting it; beyond the bound, plain join."""
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def shared_dir(spark: SparkSession) -> str | None:
    """The folder for intermediate tables that ``spark.checkpoint.dir`` names, if any."""
    return spark.conf.get(CHECKPOINT_DIR, None)


def staging_dir(spark: SparkSession) -> str:
    """A folder all executors reach: the named one, else one in the warehouse."""
    return shared_dir(spark) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/staging"


# What is staged in this process and not yet released: frames, and their paths unless persisted.
_staged: list[tuple[DataFrame, str | None]] = []


def stage(df: DataFrame, name: str, rebalance: Sequence[str] = ()) -> DataFrame:
    """Write an intermediate table once and read it back.

    This cuts the lineage: a lost executor re-reads the table instead of repeating
    the extraction. With ``rebalance`` the rows are brought together by those
    columns in evenly sized files, and a hot value is split over several. A session
    without a shared folder keeps the table in Spark's own storage instead.
    """
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not folder:
        if rebalance:
            df = df.hint("rebalance", *[F.col(c) for c in rebalance])
        kept = df.persist(StorageLevel.MEMORY_AND_DISK)
        _staged.append((kept, None))
        return kept
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    writer = df
    if rebalance:
        writer = df.hint("rebalance", *[F.col(c) for c in rebalance])
        writer.write.partitionBy(*rebalance).parquet(path)
    else:
        writer.write.parquet(path)
    rows = spark.read.schema(df.schema).parquet(path)
    _staged.append((rows, path))
    return rows


def release(spark: SparkSession) -> int:
    """Delete everything staged so far, once no result that reads it is needed."""
    gone = 0
    while _staged:
        rows, path = _staged.pop()
        if path is None:
            rows.unpersist()
        else:
            _delete(spark, path)
        gone += 1
    return gone


def discard(staged: DataFrame) -> None:
    """Delete one staged table early, once whatever reads it has been written itself.

    What Spark keeps in its own storage stays until ``release``, as it may not be filled yet.
    """
    for k, (rows, path) in enumerate(_staged):
        if rows is staged and path is not None:
            del _staged[k]
            _delete(staged.sparkSession, path)
            return


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def salted_anti(
    left: DataFrame, right: DataFrame, keys: Sequence[str], spread_by: Sequence[str], salts: int = SALTS
) -> DataFrame:
    """Rows of ``left`` whose keys are not in ``right``, with hot keys spread over tasks.

    The right side is reduced to distinct keys, which partial aggregation keeps to one
    row per key and task. Each left row takes one of ``salts`` places by its
    ``spread_by`` columns; the few distinct right rows are repeated for each place.
    Both sides then meet straight after their shuffle, so adaptive execution can split
    a place that is still too large.
    """
    keys = list(keys)
    place = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    places = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    known = right.select(*keys).distinct().select(*keys, places.alias("__place"))
    return left.withColumn("__place", place).join(known, [*keys, "__place"], "left_anti").drop("__place")


def likely_among(rows: DataFrame, wanted: DataFrame, keys: Sequence[str], bits: int = KEY_BITS) -> DataFrame:
    """The rows whose keys may be among those of ``wanted``, without moving ``rows``.

    The keys of ``wanted`` become a map of ``bits`` bits at their hashes. The map is cut
    into buckets of 4 KB, of which only those with a bit exist, so what is sent to the
    tasks is at most bits / 8 bytes however many keys there are. Every row with a wanted
    key stays; of the others about as large a share stays as bits are set. Rows with a
    null key stay only if such a key is wanted.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(bits))
    held = wanted.groupBy(F.bitmap_bucket_number(place).alias("__bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("__held")
    )
    placed = rows.withColumns({"__bucket": F.bitmap_bucket_number(place), "__bit": F.bitmap_bit_position(place)})
    byte = F.conv(F.hex(F.substring("__held", (F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = placed.join(F.broadcast(held), "__bucket")
    return found.where(F.bit_get(byte, (F.col("__bit") % 8).cast("int")) == 1).select(*rows.columns)
