"""Table layouts shared by every operator.

All operators work on plain DataFrames with these columns; extra columns are
carried along or dropped, never required.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILES = T.StructType(
    [
        T.StructField("project", T.StringType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("size", T.LongType(), True),
        T.StructField("mtime", T.TimestampType(), True),
        T.StructField("content", T.StringType(), True),
    ]
)

PROJECTS = T.StructType(
    [
        T.StructField("name", T.StringType(), False),
        T.StructField("path", T.StringType(), True),
        T.StructField("languages", T.ArrayType(T.StringType()), True),
        T.StructField("ignore_patterns", T.ArrayType(T.StringType()), True),
        T.StructField("deploy_target", T.StringType(), True),
        T.StructField("description", T.StringType(), True),
        T.StructField("supabase_project", T.StringType(), True),
    ]
)

FINDING_COLUMNS = ["project", "severity", "check", "file", "line", "message", "snippet"]
SEVERITIES = ["critical", "warning", "info"]

# One row extracted from one file. ``kind`` says which of the other columns are
# filled; ``finding`` rows are complete, all other kinds feed a join or grouping.
FACT_TYPES = {
    "kind": "string",
    "severity": "string",
    "check": "string",
    "line": "int",
    "message": "string",
    "snippet": "string",
    "name": "string",
    "value": "string",
    "num": "int",
}
FACT = "struct<" + ",".join(f"{k}:{t}" for k, t in FACT_TYPES.items()) + ">"


def sql_text(text: str) -> str:
    """A string as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fact(**fields) -> Column:
    """A FACT struct; columns not given are NULL."""
    cols = []
    for name, dtype in FACT_TYPES.items():
        value = fields.pop(name, None)
        if value is None:
            cols.append(F.expr(f"CAST(NULL AS {dtype}) AS {name}"))
            continue
        if not isinstance(value, Column):
            value = F.lit(value)
        cols.append(value.cast(dtype).alias(name))
    if fields:
        raise TypeError(f"unknown fact fields: {sorted(fields)}")
    return F.struct(*cols)


def empty(element_type: str) -> Column:
    return F.expr(f"CAST(array() AS array<{element_type}>)")


def no_facts() -> Column:
    return empty(FACT)


def facts_when(condition: Column, facts: Column) -> Column:
    """``facts`` where the condition holds, otherwise an empty list."""
    return F.when(condition, facts).otherwise(no_facts())


def findings(df: DataFrame, check: str | Column, **columns) -> DataFrame:
    """Project ``df`` onto the finding layout; missing columns become NULL."""
    out = {"check": check, **columns}
    types = {"line": "int"}
    cols = []
    for name in FINDING_COLUMNS:
        value = out.get(name)
        if name == "project" and value is None:
            value = F.col("project")
        if not isinstance(value, Column):
            value = F.lit(value)
        cols.append(value.cast(types.get(name, "string")).alias(name))
    return df.select(*cols)


def display_path(project: str | Column = "project", path: str | Column = "path") -> Column:
    return F.concat_ws("/", project, path)
