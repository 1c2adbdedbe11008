"""The full audit: read the text once, write the facts, join the rest.

``extract_facts`` turns every file into a handful of rows (finished findings,
names, fingerprints, manifests) in a single pass without a shuffle. The rows are
staged as a table clustered by kind. Whatever needs more than one file (anti-joins,
groups, comparisons between projects) then reads only its own kind from that table
and never the text again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_lang, has_suffix, in_basenames, normalise_newlines
from ..operators import dependencies as deps
from ..operators import duplicates as dups
from ..operators import clients, layout, usage
from ..operators.ages import stale
from ..operators.extract import js_facts, python_facts, small_batches, worth_reading_js
from ..operators.lines import (
    LineGroup,
    any_mask,
    error_group,
    insecure_group,
    hit_columns,
    line_hits,
    mask_column,
    not_comment,
    prefix_group,
    rule_errors,
    secret_group,
    sql_group,
    with_masks,
    worth_a_look,
)
from ..operators.multiline import match_columns, text_matches
from ..operators.work import ARROWS, IMPORTS, LONG_LINE, long_for_users, skipped, too_much
from ..rules import (
    CONFIG_EXTENSIONS,
    EXTENSIONS,
    PERFORMANCE_RULES,
    PROJECT_CHECKS,
    SAFE_BASENAMES,
    SECRET_RULES,
    Rule,
    valid_rules,
)
from ..schema import FACT_TYPES, FINDING_COLUMNS, display_path, fact, facts_when, no_facts
from ..sources.filters import filter_ignored, ignored, with_ignore
from ..sources.corpus import scan_corpus
from ..sources.registry import present_projects, read_projects, read_secret_rules, select_projects
from .scale import small_side, stage

MANIFESTS = [deps.JS_MANIFEST, deps.PY_MANIFEST, layout.IGNORE_FILE]


@dataclass
class AuditInputs:
    """Everything an audit reads.

    Files of any size are checked, unless the caller sets ``max_size``; then each larger
    file gives an info row instead. So does a file that has a size but no content.
    ``roots`` (name) are the projects whose folder exists, where the source knows, and
    ``groups`` the duplicate groups of all files, where they are already known.
    """

    files: DataFrame
    projects: DataFrame
    as_of: Column
    secret_rules: Sequence[Rule] = tuple(SECRET_RULES)
    advisories: DataFrame | None = None
    max_size: int | None = None
    strict: bool = False
    roots: DataFrame | None = None
    groups: DataFrame | None = None
    facts: DataFrame | None = field(default=None, repr=False)

    @classmethod
    def from_config(cls, spark: SparkSession, path: str, as_of: Column, **options) -> AuditInputs:
        """The projects, folders and secret patterns that a JSON config file names."""
        projects = read_projects(spark, path)
        corpus = scan_corpus(spark, projects)
        rules = read_secret_rules(spark, path)
        return cls(corpus.files, projects, as_of, secret_rules=rules, roots=corpus.roots, **options)

    def kind(self, name: str) -> DataFrame:
        return self.facts.where(F.col("kind") == name)

    def manifests(self) -> DataFrame:
        """The root files whose text is needed as a whole, as a files table."""
        return self.kind("manifest").select("project", F.col("name").alias("path"), F.col("value").alias("content"))

    def root(self) -> DataFrame:
        """Files directly in a project's root: name and time, without text."""
        stamp = F.timestamp_micros(F.col("value").cast("bigint"))
        return self.kind("root").select("project", F.col("name").alias("path"), F.lit(None).cast("bigint").alias("size"), stamp.alias("mtime"))

    def speaking(self, *languages: str) -> DataFrame:
        """Projects with one of the languages."""
        wanted = F.array(*[F.lit(x) for x in languages])
        return self.projects.where(F.arrays_overlap("languages", wanted))

    def of_projects(self, rows: DataFrame, *languages: str) -> DataFrame:
        names = self.speaking(*languages).select(F.col("name").alias("project"))
        return rows.join(names, "project", "left_semi")


def _line_groups(inputs: AuditInputs, checks: Sequence[str]) -> list[LineGroup]:
    groups = []
    if "security_scan" in checks:
        groups += [prefix_group(), secret_group(valid_rules(inputs.files.sparkSession, inputs.secret_rules)), insecure_group()]
    if "performance_lint" in checks:
        groups += [error_group(), sql_group()]
    return groups


def classified(inputs: AuditInputs) -> DataFrame:
    """Files with usable text and one flag per use of it."""
    named = inputs.projects.withColumn("languages", F.coalesce("languages", F.array().cast("array<string>")))
    files = inputs.files.join(small_side(with_ignore(named, "languages")), "project")
    path = F.col("path")
    speaks = {lang: F.array_contains("languages", lang) for lang in EXTENSIONS}
    python = speaks["python"] & has_suffix(path, EXTENSIONS["python"])
    script = (speaks["javascript"] & has_suffix(path, EXTENSIONS["javascript"])) | (
        speaks["typescript"] & has_suffix(path, EXTENSIONS["typescript"])
    )
    no_list = ~(speaks["python"] | speaks["javascript"] | speaks["typescript"])
    below = layout.migration_path(path)
    fits = F.lit(True) if inputs.max_size is None else F.col("size") <= inputs.max_size
    unread = (F.col("size") > 0) & F.col("content").isNull()
    text = F.when(fits, normalise_newlines("content"))
    flagged = files.withColumns(
        {
            "visible": ~ignored(path, F.col("ignore")),
            "migration": below.isNotNull() & ~ignored(below, F.col("ignore")),
            "manifest": path.isin(MANIFESTS),
            "python": python,
            "script": script,
            "listed": python | script | no_list,
            "config": has_suffix(path, CONFIG_EXTENSIONS),
        }
    )
    used = F.col("manifest") | F.col("migration") | (F.col("visible") & (F.col("listed") | F.col("config")))
    return flagged.withColumns({"content": F.when(used, text), "skipped": used & ~fits, "unread": used & fits & unread}).drop("languages", "ignore")


def extract_facts(inputs: AuditInputs, checks: Sequence[str] = tuple(PROJECT_CHECKS)) -> DataFrame:
    """One pass over the text: (project, path, kind, ...) rows. No shuffle."""
    col = F.col
    small_batches(inputs.files.sparkSession)
    files = classified(inputs)
    visible, text = col("visible"), col("content")
    has_text = F.coalesce(text != "", F.lit(False))
    python = visible & col("python") & has_text
    script = visible & col("script") & has_text
    listed = visible & col("listed") & has_text

    groups = _line_groups(inputs, checks)
    secrets = visible & has_text & ~in_basenames("path", SAFE_BASENAMES) & (
        col("python") | col("script") | col("config")
    )
    applies = {
        "prefix": secrets,
        "secret": secrets,
        "insecure": python | script,
        "error": listed,
        "sql": listed,
    }
    flags = {}
    if "architecture_review" in checks:
        flags = {
            "client": lambda lowered: listed & clients.mentions_client(lowered),
            "wrapper": lambda lowered: listed & clients.mentions_wrapper(lowered),
        }
    files = with_masks(files, groups, applies, flags)

    parts = [
        facts_when(
            col("manifest"), F.array(fact(kind="manifest", name=col("path"), value=F.coalesce(text, F.lit(""))))
        )
    ]
    if "security_scan" in checks:
        reasons = {"unread": "its content was not read"}
        if inputs.max_size is not None:
            reasons["skipped"] = f"more than {inputs.max_size} bytes"
        for flag, reason in reasons.items():
            said = f"File not checked: {reason}"
            unchecked = fact(kind="finding", check="security_scan", severity="info", message=said)
            parts.append(facts_when(col(flag), F.array(unchecked)))
        parts.append(skipped(secrets & long_for_users("content", inputs.secret_rules), "security_scan", LONG_LINE))
    if {"dependency_audit", "architecture_review"} & set(checks):
        stamp = F.unix_micros("mtime").cast("string")
        in_root = ~F.contains("path", F.lit("/"))
        parts.append(facts_when(in_root, F.array(fact(kind="root", name=col("path"), value=stamp))))
    if {"duplicate_code", "dead_code"} & set(checks):
        files = files.withColumn("py", python_facts(F.when(python, text)))
        parts.append(dups.extraction_errors(col("py.error"), "duplicate_code" if "duplicate_code" in checks else "dead_code"))
    if "duplicate_code" in checks:
        files = files.withColumn("arrows", script & too_much("content", ARROWS))
        files = files.withColumn("js", js_facts(F.when(script & ~col("arrows") & worth_reading_js("content"), text)))
        parts += [
            skipped(col("arrows"), "duplicate_code"),
            F.coalesce(dups.function_facts(col("py.functions")), no_facts()),
            F.coalesce(dups.block_facts(col("js.blocks")), no_facts()),
            dups.extraction_errors(col("js.error"), "duplicate_code"),
        ]
    if "dead_code" in checks:
        files = files.withColumn("imports", script & too_much("content", IMPORTS))
        parts += [
            skipped(col("imports"), "dead_code"),
            facts_when(script, usage.export_facts("content")),
            facts_when(script & ~col("imports"), usage.import_facts(text, inputs.strict)),
            F.coalesce(usage.unused_import_facts(col("py"), inputs.strict), no_facts()),
            F.coalesce(usage.definition_facts(col("py")), no_facts()),
            facts_when(python, usage.call_facts(text, inputs.strict)),
            # Ages depend on the day that is asked about, so only the time is a fact.
            facts_when(
                visible & col("listed"), F.array(fact(kind="listed", value=F.unix_micros("mtime").cast("string")))
            ),
        ]
    if "architecture_review" in checks:
        set_up = clients.client_facts(text, mentioned=col("client"))
        parts += [facts_when(listed, F.concat(set_up, clients.wrapper_facts(text, col("wrapper"))))]
    if "performance_lint" in checks:
        parts += [
            facts_when(
                listed,
                F.transform(
                    text_matches("content", PERFORMANCE_RULES, file_lang("path")),
                    lambda m: fact(kind="match", line=m["line"], value=m["found"], num=m["rule"]),
                ),
            ),
            facts_when(col("migration") & has_text, layout.unindexed_facts(text)),
        ]
    if groups:
        parts.append(
            facts_when(
                any_mask(groups),
                F.transform(F.split(text, "\n"), lambda row, i: fact(kind="line", line=i + 1, value=row)),
            )
        )
    masks = [mask_column(g) for g in groups]
    rows = files.select("project", "path", *masks, F.inline(F.concat(*parts)))
    if not groups:
        return rows.select("project", "path", *FACT_TYPES)

    # Lines worth a look become one row per hit; all other facts pass through as g = NULL.
    is_line, is_match = col("kind") == "line", col("kind") == "match"
    kept = rows.where(~is_line | worth_a_look("value", groups))
    hits = F.when(is_line, line_hits("value", groups))
    spread = kept.select("project", "path", *FACT_TYPES, F.inline_outer(hits)).where(
        ~is_line | (col("g").isNotNull() & not_comment(col("value"), col("g"), groups))
    )
    of_line = hit_columns(col("value"), display_path(), col("g"), col("hit"), groups)
    of_match = match_columns(col("num"), col("value"), PERFORMANCE_RULES)
    done = {"kind": F.lit("finding"), "value": F.lit(None), "num": F.lit(None)}

    def final(name: str) -> Column:
        value = F.when(is_line, {**of_line, **done}.get(name, col(name)))
        value = value.when(is_match, {**of_match, **done}.get(name, col(name))).otherwise(col(name))
        return value.cast(FACT_TYPES[name]).alias(name)

    changed = {*of_line, *of_match, *done}
    return spread.select("project", "path", *[final(n) if n in changed else col(n) for n in FACT_TYPES])


# --- checks ----------------------------------------------------------------


def _local(inputs: AuditInputs, check: str) -> DataFrame:
    rows = inputs.kind("finding").where(F.col("check") == check)
    return rows.withColumn("file", display_path()).select(*FINDING_COLUMNS)


def duplicate_code(inputs: AuditInputs) -> DataFrame:
    groups = inputs.groups
    if groups is None:
        groups = dups.duplicate_groups(dups.functions_from(inputs.facts))
    return _local(inputs, "duplicate_code").unionByName(dups.duplicate_findings(groups))


def security_scan(inputs: AuditInputs) -> DataFrame:
    found = _local(inputs, "security_scan").unionByName(layout.missing_entries(inputs.manifests(), inputs.projects))
    spark = inputs.files.sparkSession
    if len(valid_rules(spark, inputs.secret_rules)) == len(inputs.secret_rules):
        return found
    return found.unionByName(rule_errors(spark, inputs.secret_rules))


def dead_code(inputs: AuditInputs) -> DataFrame:
    exports = inputs.kind("export").select("project", "path", "name", "line")
    imports = inputs.kind("import").select("project", "name")
    definitions = inputs.kind("definition").select("project", "path", "name", "line")
    calls = inputs.kind("call").select("project", "name")
    stamp = F.timestamp_micros(F.col("value").cast("bigint")).alias("mtime")
    return (
        _local(inputs, "dead_code")
        .unionByName(stale(inputs.kind("listed").select("project", "path", stamp), inputs.as_of))
        .unionByName(usage.unused_export_findings(usage.unimported(exports, imports)))
        .unionByName(usage.unused_function_findings(usage.uncalled(definitions, calls)))
    )


def architecture_review(inputs: AuditInputs) -> DataFrame:
    per_project = clients.clients_per_project(inputs.kind("client"))
    versions = deps.tracked_versions(inputs.manifests())
    return (
        clients.sprawl_findings(per_project)
        .unionByName(layout.missing_counterpart(inputs.root(), inputs.projects))
        .unionByName(deps.version_mismatch(versions))
        .unionByName(clients.sprawl_global(per_project.select("project", "n_files")))
        .unionByName(clients.wrapper_global(inputs.kind("wrapper")))
    )


def dependency_audit(inputs: AuditInputs) -> DataFrame:
    advisories = inputs.advisories
    if advisories is None:
        advisories = deps.advisory_table(inputs.files.sparkSession)
    manifests = inputs.of_projects(deps.js_manifest(inputs.manifests()), "javascript", "typescript")
    requirements = inputs.of_projects(deps.py_requirements(inputs.manifests()), "python")
    columns = ["project", "ecosystem", "section", "name", "version"]
    every = deps.js_deps(manifests).select(*columns).unionByName(requirements.select(*columns))
    return (
        deps.manifest_findings(manifests)
        .unionByName(deps.vulnerable(every, advisories))
        .unionByName(deps.pre_release(deps.js_deps(manifests, "dependencies")))
        .unionByName(deps.lockfile_check(manifests, inputs.root(), inputs.as_of))
        .unionByName(deps.missing_key(manifests))
        .unionByName(deps.unpinned(requirements))
        .unionByName(layout.missing_manifest(inputs.root(), inputs.speaking("python")))
    )


def performance_lint(inputs: AuditInputs) -> DataFrame:
    return _local(inputs, "performance_lint")


# The registry, in report order. A check takes the inputs, with ``facts`` filled in,
# and returns findings; one that compares projects is a check like any other.
CHECKS: dict[str, Callable[[AuditInputs], DataFrame]] = {
    "duplicate_code": duplicate_code,
    "security_scan": security_scan,
    "dead_code": dead_code,
    "architecture_review": architecture_review,
    "dependency_audit": dependency_audit,
    "performance_lint": performance_lint,
}


def register_check(name: str, run: Callable[[AuditInputs], DataFrame]) -> None:
    """Add a user's own check to every later audit."""
    CHECKS[name] = run


def file_check(
    name: str, scan: Callable[[str, str], Iterable[tuple[str, int | None, str]]]
) -> Callable[[AuditInputs], DataFrame]:
    """A check from a function that looks at one file.

    ``scan(path, text)`` yields (severity, line, message) rows and may stop at any time. It
    runs as a table function beside each file that no glob ignores, so its rows stream on
    without being gathered. An error in one file gives a warning in place of the rest of
    that file's rows.
    """

    class Scan:
        def eval(self, path: str, text: str):
            try:
                for severity, line, message in scan(path, text):
                    yield severity, line, message
            except Exception as problem:
                yield "warning", None, f"Check failed with error: {type(problem).__name__}: {problem}"

    table = F.udtf(Scan, returnType="severity string, line int, message string")

    def run(inputs: AuditInputs) -> DataFrame:
        files = filter_ignored(inputs.files, inputs.projects).where(F.length("content") > 0)
        files = files.join(small_side(inputs.projects.select(F.col("name").alias("project"))), "project", "left_semi")
        texts = files.select("project", "path", normalise_newlines("content").alias("content"))
        rows = texts.lateralJoin(table(F.col("path").outer(), F.col("content").outer()))
        return rows.select(
            "project", "severity", F.lit(name).alias("check"), display_path().alias("file"), "line", "message",
            F.lit(None).cast("string").alias("snippet"),
        )

    return run


def audit(
    inputs: AuditInputs,
    project: str | None = None,
    check: str | None = None,
    staged: bool = True,
) -> DataFrame:
    """All findings of all projects and checks, or of one of either.

    The facts are staged in the shared folder, so the text is read once. Without
    ``staged`` they are recomputed for each kind that is asked for, which only suits
    small inputs.
    """
    if check is not None and check not in CHECKS:
        raise ValueError(f"check {check!r} not found; available: {', '.join(CHECKS)}")
    names = [check] if check else list(CHECKS)
    projects = select_projects(inputs.projects, project)
    files = inputs.files if project is None else inputs.files.where(F.col("project") == project)
    scanned = present_projects(files, projects, inputs.roots)
    if staged:
        scanned = stage(scanned, "projects")
    groups = inputs.groups if project is None else None
    chosen = replace(inputs, files=files, projects=scanned, groups=groups)
    if chosen.facts is None:
        facts = extract_facts(chosen, names)
    else:
        facts = chosen.facts if project is None else chosen.facts.where(F.col("project") == project)
    chosen.facts = stage(facts, "facts", rebalance=["kind"]) if staged else facts
    found = [CHECKS[n](chosen).select(*FINDING_COLUMNS) for n in names]
    union = found[0]
    for one in found[1:]:
        union = union.unionByName(one)
    return union
