"""Manifests, pinned versions, advisories and lock files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import age_days, clean_version, parse_version, strip
from ..plans.scale import small_side
from ..rules import ADVISORIES, LOCKFILE_DAYS, PRE_RELEASE_EXEMPT, TRACKED_PACKAGES
from ..schema import findings

CHECK = "dependency_audit"
JS_MANIFEST, JS_LOCKFILE = "package.json", "package-lock.json"
PY_MANIFEST, PY_PROJECT = "requirements.txt", "pyproject.toml"
UNPINNED = "unpinned"


# --- package.json ----------------------------------------------------------


def js_manifest(files: DataFrame) -> DataFrame:
    """One row per root ``package.json``: validity, dependency maps, top-level keys.

    The text is wrapped in a list before parsing so that anything after the first
    JSON value makes it invalid. Later sections override earlier ones in ``deps``, and of
    a repeated key the last value counts.
    """
    files.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    doc = F.expr("try_parse_json(concat('[', content, ']'))")
    parsed = files.where((F.col("path") == JS_MANIFEST) & (F.length("content") > 0)).select(
        "project", doc.alias("doc")
    )

    def section(name: str) -> Column:
        return F.expr(f"try_variant_get(doc, '$[0].{name}', 'map<string,variant>')")

    def given(name: str) -> Column:
        return F.expr(f"variant_get(doc, '$[0].{name}') IS NOT NULL")

    empty = F.expr("map()").cast("map<string,variant>")
    one_value = F.expr("doc IS NOT NULL AND variant_get(doc, '$[1]') IS NULL AND variant_get(doc, '$[0]') IS NOT NULL")
    maps = parsed.select(
        "project",
        one_value.alias("valid"),
        F.expr("schema_of_variant(variant_get(doc, '$[0]'))").startswith("OBJECT").alias("is_object"),
        F.coalesce(section("dependencies"), empty).alias("prod"),
        F.coalesce(section("devDependencies"), empty).alias("dev"),
        (
            (given("dependencies") & section("dependencies").isNull())
            | (given("devDependencies") & section("devDependencies").isNull())
        ).alias("bad_section"),
        F.expr("try_variant_get(doc, '$[0]', 'map<string,variant>')").alias("top"),
    )
    overlay = F.map_zip_with("prod", "dev", lambda k, prod, dev: F.coalesce(dev, prod))
    return maps.select(
        "project",
        F.coalesce("valid", F.lit(False)).alias("valid"),
        (F.col("valid") & (~F.coalesce("is_object", F.lit(False)) | F.col("bad_section"))).alias("malformed"),
        F.col("prod"),
        overlay.alias("deps"),
        F.map_keys("top").alias("keys"),
    )


def _entries(manifests: DataFrame, column: str) -> DataFrame:
    return manifests.where("valid").select("project", F.explode(F.map_entries(column)).alias("e")).select(
        "project",
        F.lit("javascript").alias("ecosystem"),
        F.lit("all" if column == "deps" else "dependencies").alias("section"),
        F.col("e.key").alias("name"),
        F.expr("try_cast(e.value AS string)").alias("version"),
        (F.expr("schema_of_variant(e.value)") == "STRING").alias("is_text"),
    )


def js_deps(manifests: DataFrame, section: str = "all") -> DataFrame:
    """Dependencies with a version text; ``section='dependencies'`` leaves dev ones out."""
    rows = _entries(manifests, "deps" if section == "all" else "prod")
    return rows.where("is_text").drop("is_text")


def manifest_findings(manifests: DataFrame) -> DataFrame:
    """Broken manifests and entries that carry no version text."""
    file = F.concat_ws("/", "project", F.lit(JS_MANIFEST))
    invalid = findings(
        manifests.where(~F.col("valid")),
        check=CHECK, severity="warning", file=file, message="Invalid JSON in package.json",
    )
    malformed = findings(
        manifests.where("malformed"),
        check=CHECK, severity="warning", file=F.col("project"),
        message="Check failed with error: package.json has no usable dependency sections",
    )
    entries = findings(
        _entries(manifests, "deps").where(~F.col("is_text")),
        check=CHECK, severity="warning", file=F.col("project"),
        message=F.concat(F.lit("Check failed with error: version of "), F.col("name"), F.lit(" is no text")),
    )
    return invalid.unionByName(malformed).unionByName(entries)


def missing_key(manifests: DataFrame, key: str = "engines") -> DataFrame:
    """Manifests with dependencies but without a top-level key."""
    lacking = manifests.where(F.col("valid") & (F.size(F.map_keys("deps")) > 0) & ~F.array_contains("keys", key))
    return findings(
        lacking,
        check=CHECK,
        severity="info",
        file=F.concat_ws("/", "project", F.lit(JS_MANIFEST)),
        message="No 'engines' field -- Node.js version not pinned"
        if key == "engines"
        else f"No '{key}' field in {JS_MANIFEST}",
    )


def pre_release(deps: DataFrame, exempt: Sequence[str] = tuple(PRE_RELEASE_EXEMPT)) -> DataFrame:
    """Production dependencies below version 1."""
    early = deps.where((F.get(parse_version("version"), F.lit(0)) == 0) & ~F.col("name").isin(list(exempt)))
    return findings(
        early,
        check=CHECK,
        severity="info",
        file=F.concat_ws("/", "project", F.lit(JS_MANIFEST)),
        message=F.concat(
            F.lit("Production dependency on pre-1.0: "),
            F.concat_ws("@", "name", "version"),
            F.lit(" -- may be unstable"),
        ),
    )


def lockfile_check(
    manifests: DataFrame, root_files: DataFrame, as_of: Column, max_age: int = LOCKFILE_DAYS
) -> DataFrame:
    """Lock files that are old, or missing although there are dependencies."""
    locks = root_files.where(F.col("path") == JS_LOCKFILE).select(
        "project", age_days("mtime", as_of).alias("age"), F.lit(True).alias("present")
    )
    joined = manifests.where("valid").join(locks, "project", "left")
    old = F.coalesce("present", F.lit(False)) & (F.col("age") > max_age)
    gone = F.col("present").isNull() & (F.size(F.map_keys("deps")) > 0)
    return findings(
        joined.where(old | gone),
        check=CHECK,
        severity=F.when(old, "info").otherwise("warning"),
        file=F.concat_ws("/", "project", F.lit(JS_LOCKFILE)),
        message=F.when(
            old,
            F.concat(
                F.lit("Lockfile is "),
                F.col("age").cast("bigint").cast("string"),
                F.lit(" days old -- consider running npm audit / npm update"),
            ),
        ).otherwise("No lockfile found -- builds may be non-deterministic"),
    )


# --- requirements.txt ------------------------------------------------------


def _requirement_lines(files: DataFrame) -> DataFrame:
    found = files.where((F.col("path") == PY_MANIFEST) & F.col("content").isNotNull())
    return found.select("project", F.posexplode(F.split("content", "\n")).alias("pos", "raw")).select(
        "project", "pos", strip("raw").alias("text")
    )


def _cut(text: Column, mark: str) -> tuple[Column, Column]:
    """What stands before and after the first ``mark``, stripped."""
    at = F.instr(text, mark)
    before = F.substring(text, F.lit(1), at - 1)
    after = F.substring(text, at + len(mark), F.length(text))
    return strip(before), strip(after)


def py_requirements(files: DataFrame) -> DataFrame:
    """Pinned and unpinned requirements: names in lower case, the last line of a name wins.

    ``pos`` is the line on which a name first appears.
    """
    text = F.col("text")
    exact, least = F.contains(text, F.lit("==")), F.contains(text, F.lit(">="))
    exact_name, exact_version = _cut(text, "==")
    least_name, least_version = _cut(text, ">=")
    bare = strip(F.regexp_extract(text, r"\A([^<>=!]*)", 1))
    rows = _requirement_lines(files).where((text != "") & ~text.startswith("#"))
    parsed = rows.select(
        "project",
        "pos",
        F.lower(F.when(exact, exact_name).when(least, least_name).otherwise(bare)).alias("name"),
        F.when(exact, exact_version).when(least, least_version).otherwise(UNPINNED).alias("version"),
        (exact | least | (~text.startswith("-") & (bare != ""))).alias("counts"),
    )
    return (
        parsed.where("counts")
        .groupBy("project", "name")
        .agg(F.max_by("version", "pos").alias("version"), F.min("pos").alias("pos"))
        .select(
            "project",
            F.lit("python").alias("ecosystem"),
            F.lit("requirements").alias("section"),
            "name",
            "version",
            "pos",
        )
    )


def unpinned(deps: DataFrame, shown: int = 10) -> DataFrame:
    """One row per project with unpinned requirements, naming the first ones.

    A project has one requirements file of bounded size, so its list is bounded too.
    """
    names = F.transform(
        F.slice(F.array_sort(F.collect_list(F.struct("pos", "name"))), 1, shown), lambda s: s["name"]
    )
    rows = deps.where(F.col("version") == UNPINNED).groupBy("project").agg(names.alias("names"))
    return findings(
        rows,
        check=CHECK,
        severity="warning",
        file=F.concat_ws("/", "project", F.lit(PY_MANIFEST)),
        message=F.concat(
            F.lit("Unpinned Python dependencies (non-reproducible): "), F.array_join("names", ", ")
        ),
    )


def advisory_table(spark, advisories: Sequence[tuple] = tuple(ADVISORIES)) -> DataFrame:
    """The advisory list as a table that lives in the plan, with its size known."""
    fields = ["ecosystem", "package", "version_prefix", "note"]
    rows = [F.struct(*[F.lit(v).alias(f) for f, v in zip(fields, row)]) for row in advisories]
    return spark.sql("SELECT 1").select(F.inline(F.array(*rows)))


def vulnerable(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """Dependencies whose version starts with an advisory's prefix.

    Equality on ecosystem and name keeps this a hash join; the prefix is a residual
    test. A dependency may match several advisories.
    """
    known = advisories.select(
        "ecosystem",
        F.when(F.col("ecosystem") == "python", F.lower("package")).otherwise(F.col("package")).alias("name"),
        "version_prefix",
        "note",
    )
    shown = F.when(F.col("ecosystem") == "python", F.col("version")).otherwise(clean_version("version"))
    pinned = deps.where(F.col("version") != UNPINNED).select("project", "ecosystem", "name", shown.alias("shown"))
    hits = pinned.join(small_side(known), ["ecosystem", "name"]).where(F.startswith("shown", "version_prefix"))
    python = F.col("ecosystem") == "python"
    return findings(
        hits,
        check=CHECK,
        severity="warning",
        file=F.concat_ws("/", "project", F.when(python, PY_MANIFEST).otherwise(JS_MANIFEST)),
        message=F.concat(
            F.lit("Potentially vulnerable: "),
            F.col("name"),
            F.when(python, "==").otherwise("@"),
            F.col("shown"),
            F.lit(" -- "),
            F.col("note"),
        ),
    )


# --- tracked versions ------------------------------------------------------


def tracked_versions(files: DataFrame, tracked: Sequence[str] = tuple(TRACKED_PACKAGES)) -> DataFrame:
    """Versions to compare across projects: some JavaScript packages, all Python pins.

    Python pins keep their case and their ``>=``, comment lines included, and
    override a JavaScript package of the same name.
    """
    js = js_deps(js_manifest(files)).where(F.col("name").isin(list(tracked))).select(
        "project", "name", "version", F.lit(1).alias("priority"), F.lit(0).alias("pos")
    )
    text = F.col("text")
    exact, least = F.contains(text, F.lit("==")), F.contains(text, F.lit(">="))
    exact_name, exact_version = _cut(text, "==")
    least_name, least_version = _cut(text, ">=")
    py = (
        _requirement_lines(files)
        .where(exact | least)
        .select(
            "project",
            F.when(exact, exact_name).otherwise(least_name).alias("name"),
            F.when(exact, exact_version).otherwise(F.concat(F.lit(">="), least_version)).alias("version"),
            F.lit(0).alias("priority"),
            (-F.col("pos")).alias("pos"),
        )
    )
    return (
        js.unionByName(py)
        .groupBy("project", "name")
        .agg(F.min_by("version", F.struct("priority", "pos")).alias("version"))
    )


def mismatched(versions: DataFrame) -> DataFrame:
    """(name, projects, versions, low, high) of packages used in more than one version.

    ``versions`` has one row per (project, name). Equal versions are counted first, so a
    package that all projects use costs one row per version and task.
    """
    per_version = versions.groupBy("name", "version").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_version.groupBy("name")
        .agg(
            F.sum("n").alias("projects"),
            F.count(F.lit(1)).alias("versions"),
            F.min("version").alias("low"),
            F.max("version").alias("high"),
        )
        .where(F.col("versions") > 1)
    )


def mismatch_versions(versions: DataFrame) -> DataFrame:
    """The projects and versions behind every mismatch: (name, project, version)."""
    names = mismatched(versions).select("name")
    return versions.join(names, "name", "left_semi").select("name", "project", "version")


def version_mismatch(versions: DataFrame) -> DataFrame:
    """Packages that projects use in different versions (compared as written)."""
    return findings(
        mismatched(versions),
        check="architecture_review",
        project=F.lit(None),
        severity="warning",
        file="(cross-project)",
        message=F.concat(
            F.lit("Version mismatch for '"),
            F.col("name"),
            F.lit("': "),
            F.col("versions").cast("string"),
            F.lit(" versions in "),
            F.col("projects").cast("string"),
            F.lit(" projects, from "),
            F.col("low"),
            F.lit(" to "),
            F.col("high"),
        ),
    )
