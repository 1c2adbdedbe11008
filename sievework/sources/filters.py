"""Which files count: ignore globs, suffixes, size caps."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_suffix, in_basenames, normalise_newlines
from ..plans.scale import small_side
from ..rules import LARGE_FILE_SIZE, MAX_FILE_SIZE, SAFE_BASENAMES


def glob_regex(glob: str, within_component: bool = False) -> str:
    """A shell glob as an unanchored Java pattern.

    ``*`` and ``?`` also match ``/`` unless the pattern is for one path component.
    """
    anything = "[^/]" if within_component else "."
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        end = glob.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append(anything + "*")
        elif ch == "?":
            out.append(anything)
        elif end > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            if body[0] == "!":
                body = "^" + body[1:] + ("/" if within_component else "")
            elif body[0] == "^":
                body = "\\" + body
            out.append(f"[{body}]")
            i = end
        else:
            out.append(ch if ch.isalnum() or ch in "_/" else "\\" + ch)
        i += 1
    return "".join(out)


def ignore_regex(globs: Iterable[str]) -> tuple[str, str, str]:
    """Three patterns: over the whole path, its components, and ``./`` + its root directory.

    A path is dropped when a component matches a glob, when the whole path does, or
    when one of its parent directories does, as nothing below it would be visited.
    """
    globs = list(globs)
    whole = "|".join(glob_regex(g) for g in globs)
    component = "|".join(glob_regex(g, within_component=True) for g in globs)
    return (
        rf"(?s)\A(?:{whole})(?:/|\z)",
        rf"(?s)(?:\A|/)(?:{component})(?:/|\z)",
        rf"(?s)\A(?:{whole})\z",
    )


def path_ignored(path: Column, globs: Iterable[str]) -> Column:
    """Whether one given list of globs ignores ``path``."""
    globs = list(globs)
    if not globs:
        return F.lit(False)
    whole, component, root = (F.lit(p) for p in ignore_regex(globs))
    return ignored(path, {"whole": whole, "component": component, "root": root})


PATTERNS = "struct<whole:string,component:string,root:string>"


def _patterns(globs: list[str] | None) -> tuple[str, str, str] | None:
    return ignore_regex(g for g in globs if g is not None) if globs else None


def with_ignore(projects: DataFrame, *carry: str) -> DataFrame:
    """(project, ignore, ...): every project's globs as patterns, any number of lists.

    Only registry rows pass through Python. A project without globs has NULL patterns.
    """
    return projects.select(F.col("name").alias("project"), F.udf(_patterns, PATTERNS)("ignore_patterns").alias("ignore"), *carry)


def ignored(path: Column, patterns: Column | dict[str, Column]) -> Column:
    """Whether the patterns of a file's project ignore ``path``."""
    top = F.concat(F.lit("./"), F.substring_index(path, "/", 1))
    found = (
        F.rlike(path, patterns["component"])
        | F.rlike(path, patterns["whole"])
        | (F.contains(path, F.lit("/")) & F.rlike(top, patterns["root"]))
    )
    return F.coalesce(found, F.lit(False))


def filter_ignored(files: DataFrame, projects: DataFrame) -> DataFrame:
    """Drop files that a glob of their project ignores."""
    dimension = small_side(with_ignore(projects))
    joined = files.join(dimension, "project", "left")
    return joined.where(~ignored(F.col("path"), F.col("ignore"))).drop("ignore")


def filter_ext(files: DataFrame, suffixes: Iterable[str]) -> DataFrame:
    """Keep files with one of the suffixes; no suffixes means no filter."""
    suffixes = list(suffixes)
    return files.where(has_suffix("path", suffixes)) if suffixes else files


def exclude_basenames(files: DataFrame, names: Iterable[str] = tuple(SAFE_BASENAMES)) -> DataFrame:
    return files.where(~in_basenames("path", names))


def read_text(files: DataFrame, max_size: int = MAX_FILE_SIZE, keep_empty: bool = False) -> DataFrame:
    """Files with usable text: within the size cap, newlines normalised.

    Bytes that are no UTF-8 are dropped. Empty text is left out unless kept.
    """
    content = F.col("content")
    if dict(files.dtypes)["content"] == "binary":
        content = F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))
    out = files.where(F.col("size") <= max_size).withColumn("content", normalise_newlines(content))
    if keep_empty:
        return out.where(F.col("content").isNotNull())
    return out.where(F.length("content") > 0)


def large_files(files: DataFrame, min_bytes: int = LARGE_FILE_SIZE) -> DataFrame:
    """Files over ``min_bytes``; reads no content."""
    return files.where(F.col("size") > min_bytes).select("project", "path", "size")
