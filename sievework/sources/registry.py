"""The project registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..rules import Rule, user_secret_rules
from ..schema import PROJECTS

CONFIG = T.StructType(
    [
        T.StructField("projects", T.ArrayType(PROJECTS)),
        T.StructField("secret_patterns", T.ArrayType(T.StringType())),
    ]
)


def read_config(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CONFIG).json(path, multiLine=True, mode="FAILFAST")


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """The project list of a JSON config file; optional keys become NULL."""
    return read_config(spark, path).select(F.inline("projects"))


def read_secret_rules(spark: SparkSession, path: str) -> list[Rule]:
    """The secret rules of a config file, in its order; none if it names none."""
    row = read_config(spark, path).select("secret_patterns").first()
    return user_secret_rules((row[0] if row else None) or [])


def select_projects(projects: DataFrame, name: str | None = None, strict: bool = True) -> DataFrame:
    """One project or all; an unknown name is an error unless ``strict`` is off."""
    if name is None:
        return projects
    chosen = projects.where(F.col("name") == name)
    if strict and chosen.isEmpty():
        raise ValueError(f"project {name!r} not found")
    return chosen


def present_projects(files: DataFrame, projects: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Projects whose folder exists; the others count as not scanned.

    ``roots`` (name) tells which folders a scan has found, empty ones too. Without it only
    projects that have a file are known to exist.
    """
    seen = files.select(F.col("project").alias("name"))
    if roots is not None:
        seen = seen.unionByName(roots.select("name"))
    return projects.join(seen.distinct(), "name", "left_semi")
