"""Code nobody uses: exports, imports and functions without a reference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matching import matched_lines
from ..functions.text import in_basenames, strip
from ..plans.scale import likely_among, salted_anti, stage
from ..rules import (
    EXPORT_PATTERN,
    FRAMEWORK_BASENAMES,
    FRAMEWORK_EXPORTS,
    IMPORT_PATTERN,
    WORD,
    holds,
    java_pattern,
)
from ..schema import display_path, fact, findings, no_facts
from .extract import python_facts

CHECK = "dead_code"
JS_FILES = r"\.(?:js|mjs|cjs|ts|tsx)\z"
CALL_PATTERN = rf"(?<![{WORD}])(?:def[ \t]+)?[{WORD}]++\s*+\("


# --- exports ---------------------------------------------------------------


def export_sites(text: str) -> Column:
    """Exported names with their lines: array<struct<name,line>>, NULL without any."""
    item = "named_struct('name', m.found, 'line', m.line)"
    return F.expr(matched_lines(text, EXPORT_PATTERN, item, group=1, possible=holds(text, "export")))


def export_facts(text: str) -> Column:
    sites = F.transform(export_sites(text), lambda s: fact(kind="export", line=s["line"], name=s["name"]))
    return F.coalesce(sites, no_facts())


def imported_names(text: Column, strict: bool = False) -> Column:
    """Names that a JavaScript text imports, each once.

    For ``B as C`` that is B, the name the other file exports; ``strict`` takes C.
    """
    pattern = F.lit(java_pattern(IMPORT_PATTERN))
    which = 1 if strict else 0

    def local(part: Column) -> Column:
        return strip(
            F.when(F.contains(strip(part), F.lit(" as ")), F.get(F.split(strip(part), " as "), F.lit(which))).otherwise(part)
        )

    braces = F.regexp_extract_all(text, pattern, F.lit(1))
    listed = F.flatten(F.transform(braces, lambda b: F.transform(F.split(b, ","), local)))
    defaults = F.regexp_extract_all(text, pattern, F.lit(2))
    names = F.filter(F.array_distinct(F.concat(listed, defaults)), lambda n: n != "")
    # "import" starts at too many places of prose; see ``needle_parts``.
    held = F.contains(text, F.lit("port")) & F.contains(text, F.lit("import"))
    return F.when(held, names).otherwise(F.array().cast("array<string>"))


def import_facts(text: Column, strict: bool = False) -> Column:
    return F.transform(imported_names(text, strict), lambda n: fact(kind="import", name=n))


def exports_of(files: DataFrame) -> DataFrame:
    """Export sites (project, path, name, line) of JavaScript and TypeScript files."""
    scripts = files.where(F.col("path").rlike(JS_FILES))
    return scripts.select("project", "path", F.inline(export_sites("content")))


def imports_of(files: DataFrame, strict: bool = False) -> DataFrame:
    """Distinct imported names per project."""
    return (
        files.where(F.col("path").rlike(JS_FILES))
        .select("project", F.explode(imported_names(F.col("content"), strict)).alias("name"))
        .distinct()
    )


def unimported(
    exports: DataFrame,
    imports: DataFrame,
    framework_names: Sequence[str] = tuple(FRAMEWORK_EXPORTS),
    framework_files: Sequence[str] = tuple(FRAMEWORK_BASENAMES),
) -> DataFrame:
    """Export sites whose name no file of the project imports.

    One project, or one name in it, may hold a large part of the exports: they are
    spread over tasks by their site.
    """
    candidates = exports.where(
        ~F.col("name").isin(list(framework_names)) & ~in_basenames("path", framework_files)
    )
    return salted_anti(candidates, imports, ["project", "name"], spread_by=["path", "line"])


def unused_export_findings(sites: DataFrame) -> DataFrame:
    return findings(
        sites,
        check=CHECK,
        severity="info",
        file=display_path(),
        line=F.col("line"),
        message=F.concat(F.lit("Exported function '"), F.col("name"), F.lit("' not imported anywhere in project")),
    )


def unused_exports(files: DataFrame, strict: bool = False) -> DataFrame:
    return unused_export_findings(unimported(exports_of(files), imports_of(files, strict)))


# --- imports ---------------------------------------------------------------


def unused_import_sites(py: Column, strict: bool = False) -> Column:
    """Imports of one file that nothing in it refers to: array<struct<name,line>>.

    A later import of the same name replaces an earlier one. A dotted import is used
    when its first component is; ``strict`` compares the whole dotted name.
    """
    names = F.array_distinct(F.transform(py["imports"], lambda i: i["name"]))
    kept = F.filter(
        names,
        lambda n: ~n.startswith("_")
        & ~n.isin("annotations", "absolute_import")
        & ~F.array_contains(py["used"], n if strict else F.substring_index(n, ".", 1)),
    )

    def last_line(name: Column) -> Column:
        same = F.filter(py["imports"], lambda i: i["name"] == name)
        return F.struct(name.alias("name"), F.element_at(same, -1)["line"].alias("line"))

    return F.transform(kept, last_line)


def unused_import_facts(py: Column, strict: bool = False) -> Column:
    return F.transform(
        unused_import_sites(py, strict),
        lambda s: fact(
            kind="finding",
            check=CHECK,
            severity="info",
            line=s["line"],
            message=F.concat(F.lit("Unused import: "), s["name"]),
        ),
    )


def unused_imports(files: DataFrame, strict: bool = False) -> DataFrame:
    """Unused Python imports. Names and uses come from the same file: no join, no shuffle."""
    parsed = files.where(F.col("path").endswith(".py")).select(
        "project", "path", python_facts(F.col("content")).alias("py")
    )
    rows = parsed.select("project", "path", F.inline(unused_import_sites(F.col("py"), strict)))
    return findings(
        rows,
        check=CHECK,
        severity="info",
        file=display_path(),
        line=F.col("line"),
        message=F.concat(F.lit("Unused import: "), F.col("name")),
    )


# --- functions -------------------------------------------------------------


def called_names(text: Column, strict: bool = False) -> Column:
    """Names followed by a parenthesis, each once; definitions only count when strict."""
    calls = F.array_distinct(F.regexp_extract_all(text, F.lit(CALL_PATTERN), F.lit(0)))
    if not strict:
        calls = F.filter(calls, lambda c: ~c.rlike(rf"\Adef[ \t]+[{WORD}]"))
    names = F.array_distinct(F.transform(calls, lambda c: F.regexp_extract(c, rf"([{WORD}]+)\s*\(\z", 1)))
    return F.when(F.contains(text, F.lit("(")), names).otherwise(F.array().cast("array<string>"))


def call_facts(text: Column, strict: bool = False) -> Column:
    return F.transform(called_names(text, strict), lambda n: fact(kind="call", name=n))


def definition_facts(py: Column) -> Column:
    """Top-level functions that their own file does not mention again."""
    lonely = F.filter(py["toplevel"], lambda d: ~d["elsewhere"])
    return F.transform(lonely, lambda d: fact(kind="definition", name=d["name"], line=d["line"]))


def uncalled(definitions: DataFrame, calls: DataFrame) -> DataFrame:
    """Definitions whose name nothing in their project calls.

    Most calls name nothing that is defined here. A map of the definitions' names drops
    them where they are read; what is left is made distinct in each task, so a name that
    every file of a large project calls is one row of each, and only those rows move.
    """
    keys = ["project", "name"]
    relevant = likely_among(calls.select(*keys), definitions.select(*keys), keys)
    return salted_anti(definitions, relevant, keys, spread_by=["path", "line"])


def unused_function_findings(sites: DataFrame) -> DataFrame:
    return findings(
        sites,
        check=CHECK,
        severity="info",
        file=display_path(),
        line=F.col("line"),
        message=F.concat(
            F.lit("Potentially unused function: "),
            F.col("name"),
            F.lit("() -- not called anywhere in "),
            F.col("project"),
        ),
    )


def unused_functions(files: DataFrame, strict: bool = False) -> DataFrame:
    python = files.where(F.col("path").endswith(".py"))
    parsed = python.select("project", "path", python_facts(F.col("content")).alias("py"))
    definitions = parsed.select("project", "path", F.inline(definition_facts(F.col("py"))))
    definitions = stage(definitions.select("project", "path", "name", "line"), "definitions")
    calls = python.select("project", F.explode(called_names(F.col("content"), strict)).alias("name"))
    return unused_function_findings(uncalled(definitions, calls))
