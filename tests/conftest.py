import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.default.parallelism", "2")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("staging")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def files(spark):
    """Build a files table from (project, path, content[, mtime]) tuples."""

    def build(*rows):
        full = [(r[0], r[1], len((r[2] or "").encode()), r[3] if len(r) > 3 else None, r[2]) for r in rows]
        return spark.createDataFrame(
            full, "project string, path string, size bigint, mtime timestamp, content string"
        )

    return build


@pytest.fixture
def projects(spark):
    def build(*names, languages=("python", "javascript", "typescript"), ignore=("node_modules",)):
        return spark.createDataFrame(
            [(n, None, list(languages), list(ignore)) for n in names],
            "name string, path string, languages array<string>, ignore_patterns array<string>",
        )

    return build
