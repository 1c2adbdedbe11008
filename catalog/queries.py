"""One query per operator of the inventory, over whole tables.

Every query returns plain columns under fixed names, the same as its SQL equivalent
in ``oracle``. Missing values are shown as '' or 0 so that both engines agree.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework import operators as op
from sievework.functions import clean_version, entropy, file_lang, parse_version, redact
from sievework.operators.clients import client_files, clients_per_project
from sievework.operators.lines import (
    error_group,
    insecure_group,
    line_scan,
    prefix_group,
    secret_group,
    sql_group,
)
from sievework.plans import report
from sievework.plans.audit import CHECKS, AuditInputs, audit, file_check, register_check
from sievework.plans.scale import stage, staging_dir
from sievework.rules import (
    CONFIG_EXTENSIONS,
    EXPENSIVE_RULES,
    EXTENSIONS,
    IGNORE_ALTERNATIVES,
    N_PLUS_1_RULES,
    REQUIRED_IGNORE_ENTRIES,
    SECRET_RULES,
    UNBOUNDED_RULES,
    Rule,
    user_secret_rules,
)
from sievework.schema import display_path
from sievework.sources import (
    exclude_basenames,
    filter_ext,
    filter_ignored,
    large_files,
    present_projects,
    read_text,
    scan_corpus,
    select_projects,
)

from sievework.streaming import audit_so_far, audit_stream

from . import inputs

RUN_DATE = "2024-01-01"
IGNORED = ["node_modules", "dist", "*.md", "config/*"]
CAP = 5_000

# Rules of a user, added to the built-in ones.
USER_SECRET = Rule(r'token\s*=\s*"[0-9a-f]{40}"', "Token in text", "warning", needles=("token",))
# As a config file names them: nothing is known of how they search.
USER_PATTERNS = user_secret_rules([r"key-[0-9]", r"user-[0-9a-f]{32}"])
TEXT_RULES = [
    Rule(r"[A-Za-z0-9._]+@[A-Za-z0-9.]+\.[a-z]{2,}", "E-mail address", "warning", needles=("@",)),
    Rule(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "Network address", "info"),
    Rule(r'token\s*=\s*"', "Token assignment", "critical", needles=("token",)),
    Rule(r"(?i)licen[cs]e", "License line", "info", needles=("licen",)),
]
PAGE_RULES = [
    Rule(r"<h[1-3]>[^<]*</h[1-3]>", "Heading", "info", needles=("<h1", "<h2", "<h3")),
    Rule(r"<script>[\s\S]{0,400}?</script>", "Inline script", "warning", needles=("<script",)),
    Rule(r"<a\s+href=\"[^\"]*\">", "Link", "info", needles=("<a",)),
    Rule(r"\.select\s*\(\s*['\"]?\*['\"]?\s*\)", "Select star", "warning", needles=(".select",)),
    Rule(r"except\s*:", "Bare except", "warning", needles=("except",)),
]
LICENSE_PATTERN = r"(?i)licen[cs]ed under"


def plain(found: DataFrame) -> DataFrame:
    """Findings with missing values shown."""
    return found.select(
        F.coalesce("project", F.lit("")).alias("project"),
        "severity",
        "check",
        "file",
        F.coalesce("line", F.lit(0)).cast("bigint").alias("line"),
        "message",
        F.coalesce("snippet", F.lit("")).alias("snippet"),
    )


def code_and_docs(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.code(spark, sf).unionByName(inputs.documents(spark, sf))


def ignore_registry(files: DataFrame) -> DataFrame:
    return inputs.code_projects(files).withColumn(
        "ignore_patterns", F.array(*[F.lit(g) for g in IGNORED])
    )


# --- sources ---------------------------------------------------------------


def q_corpus(spark, sf):
    docs = inputs.documents(spark, sf)
    return docs.groupBy("project").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("n_bytes"), F.max("size").alias("largest")
    )


def q_lines(spark, sf):
    rows = op.lines(inputs.documents(spark, sf))
    return rows.groupBy("project", "path").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(F.col("text") == "").alias("n_empty"),
        F.sum(F.length("text")).alias("n_chars"),
    )


def q_comments(spark, sf):
    rows = op.drop_comments(op.lines(code_and_docs(spark, sf)))
    return rows.groupBy("project", "path").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("text")).alias("n_chars")
    )


def q_ignore(spark, sf):
    files = inputs.code(spark, sf)
    return filter_ignored(files, ignore_registry(files)).select("project", "path", "size")


def q_ext(spark, sf):
    files = filter_ext(
        inputs.code(spark, sf), EXTENSIONS["python"] + EXTENSIONS["typescript"] + CONFIG_EXTENSIONS
    )
    return exclude_basenames(files, ["package.json"]).select(
        "project", "path", file_lang("path").alias("lang")
    )


def q_select(spark, sf):
    files = inputs.code(spark, sf)
    chosen = select_projects(inputs.code_projects(files), "p1", strict=False)
    return (
        files.join(chosen.select(F.col("name").alias("project")), "project", "left_semi")
        .select("project", "path", "size")
    )


def q_absent(spark, sf):
    files = inputs.code(spark, sf)
    registry = inputs.code_projects(files)
    ghosts = registry.withColumn("name", F.concat(F.lit("absent-"), "name"))
    return present_projects(files, registry.unionByName(ghosts)).select(F.col("name").alias("project"))


def q_scan(spark, sf):
    """The documents written as directory trees and scanned from there."""
    corpus = scan_corpus(spark, inputs.documents_in_trees(spark, sf))
    return corpus.files.select("project", "path", "size", F.md5(F.col("content").cast("binary")).alias("digest"))


def q_read_cap(spark, sf):
    return read_text(inputs.documents(spark, sf), max_size=CAP).select(
        "project", "path", "size", F.length("content").cast("bigint").alias("n_chars")
    )


def q_large(spark, sf):
    return large_files(inputs.documents(spark, sf), min_bytes=CAP)


# --- scalar functions ------------------------------------------------------


def q_entropy(spark, sf):
    tokens = F.explode(F.regexp_extract_all("content", F.lit('"([^"\n]+)"'), F.lit(1))).alias("token")
    rows = code_and_docs(spark, sf).select("project", "path", tokens)
    return rows.withColumn("entropy", F.round(entropy("token"), 6))


def q_redact(spark, sf):
    rows = op.lines(code_and_docs(spark, sf)).where(F.col("text").rlike("[\"']"))
    return rows.select("project", "path", F.col("line").cast("bigint").alias("line"), redact("text").alias("shown"))


def q_version(spark, sf):
    deps = op.js_deps(op.js_manifest(inputs.code(spark, sf)))
    part = parse_version("version")
    return deps.select(
        "project",
        "name",
        clean_version("version").alias("clean"),
        F.coalesce(F.get(part, F.lit(0)), F.lit(-1)).cast("bigint").alias("major"),
        F.coalesce(F.get(part, F.lit(1)), F.lit(-1)).cast("bigint").alias("minor"),
        F.coalesce(F.get(part, F.lit(2)), F.lit(-1)).cast("bigint").alias("patch"),
    )


def q_pre_release(spark, sf):
    return plain(op.pre_release(op.js_deps(op.js_manifest(inputs.code(spark, sf)), "dependencies")))


# --- rules -----------------------------------------------------------------


def q_prefix(spark, sf):
    return plain(op.prefix_scan(code_and_docs(spark, sf)))


def q_secret(spark, sf):
    return plain(op.secret_scan(code_and_docs(spark, sf), [*SECRET_RULES, USER_SECRET]))


def q_downgrade(spark, sf):
    found = op.first_match_scan(code_and_docs(spark, sf), [USER_SECRET, *SECRET_RULES[2:3]])
    return plain(op.downgrade(found, ["test", "src1", "keys."]))


def q_first(spark, sf):
    return plain(op.first_match_scan(inputs.documents(spark, sf), TEXT_RULES))


def q_insecure(spark, sf):
    return plain(line_scan(inputs.code(spark, sf), [insecure_group()]))


def q_groups(spark, sf):
    sets = {"contact": TEXT_RULES[:2], "other": TEXT_RULES[2:]}
    docs = op.first_match_scan(inputs.documents(spark, sf), sets)
    return plain(docs.unionByName(line_scan(inputs.code(spark, sf), [error_group(), sql_group()])))


def q_multi(spark, sf):
    files = inputs.code(spark, sf).unionByName(inputs.pages(spark, sf))
    return plain(op.multiline_scan(files, PAGE_RULES))


def q_rules(spark, sf):
    """Every whole-text rule but the loop folds, with hits and near misses in every document."""
    rules = N_PLUS_1_RULES + UNBOUNDED_RULES + EXPENSIVE_RULES
    return plain(op.multiline_scan(inputs.written(spark, sf, inputs.RULES_SQL), rules))


def q_prefixes(spark, sf):
    """Every key prefix, with a near miss of each."""
    return plain(op.prefix_scan(inputs.written(spark, sf, inputs.KEYS_SQL)))


def q_absent_within(spark, sf):
    return plain(
        op.absent_within(
            inputs.code(spark, sf),
            r"\.select\s*\(\s*['\"]?\*['\"]?\s*\)",
            r"\.limit\s*\(",
            200,
            "Unbounded SELECT * without .limit() -- may return entire table",
        )
    )


def q_loop(spark, sf):
    return plain(op.loop_scan(inputs.code(spark, sf)))


# --- joins -----------------------------------------------------------------


def q_exports(spark, sf):
    return plain(op.unused_exports(inputs.code(spark, sf)))


def q_exports_strict(spark, sf):
    return plain(op.unused_exports(inputs.code(spark, sf), strict=True))


def q_imports(spark, sf):
    return plain(op.unused_imports(inputs.code(spark, sf)))


def q_unused_fn(spark, sf):
    return plain(op.unused_functions(inputs.code(spark, sf)))


def q_advisory(spark, sf):
    files = inputs.code(spark, sf)
    columns = ["project", "ecosystem", "name", "version"]
    deps = op.js_deps(op.js_manifest(files)).select(*columns)
    return plain(
        op.vulnerable(deps.unionByName(op.py_requirements(files).select(*columns)), op.advisory_table(spark))
    )


def q_fk(spark, sf):
    return plain(op.unindexed_fks(inputs.code(spark, sf)))


def q_required(spark, sf):
    files = inputs.code(spark, sf)
    return plain(
        op.missing_entries(files, inputs.code_projects(files), REQUIRED_IGNORE_ENTRIES, IGNORE_ALTERNATIVES)
    )


def q_counterpart(spark, sf):
    files = inputs.code(spark, sf)
    return plain(op.missing_counterpart(files, inputs.code_projects(files)))


def q_lock(spark, sf):
    files = inputs.code(spark, sf)
    return plain(op.lockfile_check(op.js_manifest(files), op.root_files(files), inputs.as_of()))


def q_no_manifest(spark, sf):
    files = inputs.code(spark, sf)
    return plain(op.missing_manifest(files, inputs.code_projects(files)))


def q_manifest(spark, sf):
    manifests = op.js_manifest(inputs.code(spark, sf))
    return plain(op.manifest_findings(manifests).unionByName(op.missing_key(manifests)))


def q_reqs(spark, sf):
    return op.py_requirements(inputs.code(spark, sf)).select(
        "project", "name", "version", F.col("pos").cast("bigint").alias("pos")
    )


def q_unpinned(spark, sf):
    return plain(op.unpinned(op.py_requirements(inputs.code(spark, sf))))


def q_tracked(spark, sf):
    return op.tracked_versions(inputs.code(spark, sf))


# --- groups ----------------------------------------------------------------


def _groups(functions: DataFrame, with_fp: bool) -> DataFrame:
    groups = op.duplicate_groups(functions)
    shown = groups.select(
        *(["fp"] if with_fp else []),
        "n",
        "cross_project",
        F.concat_ws("/", "site.project", "site.path").alias("file"),
    )
    return shown


def q_dups(spark, sf):
    return _groups(op.text_blocks(inputs.documents(spark, sf)), with_fp=True)


def q_dup_sites(spark, sf):
    functions = stage(op.text_blocks(inputs.documents(spark, sf)), "functions")
    sites = op.duplicate_sites(functions, op.duplicate_groups(functions))
    return sites.select("project", "path", "fp", "copies", "cross_project")


def q_dups_py(spark, sf):
    return plain(op.duplicate_findings(op.duplicate_groups(op.py_functions(inputs.code(spark, sf)))))


def q_dups_js(spark, sf):
    return plain(op.duplicate_findings(op.duplicate_groups(op.js_functions(inputs.code(spark, sf)))))


def q_sprawl(spark, sf):
    return plain(op.sprawl(inputs.documents(spark, sf), LICENSE_PATTERN, min_files=2))


def q_sprawl_global(spark, sf):
    counts = clients_per_project(client_files(inputs.code(spark, sf))).select("project", "n_files")
    return plain(op.sprawl_global(counts))


def q_sprawl_counts(spark, sf):
    return clients_per_project(client_files(inputs.code(spark, sf))).select("project", "n_files")


def q_wrappers(spark, sf):
    return op.wrappers(inputs.code(spark, sf))


def q_wrapper_global(spark, sf):
    return plain(op.wrapper_global(op.wrappers(inputs.code(spark, sf))))


def _part_versions(spark, sf):
    """One type per brand and part name, as versions of packages in projects."""
    part = inputs.read(spark, sf, "part")
    return part.groupBy(F.col("p_brand").alias("project"), F.col("p_name").alias("name")).agg(
        F.min("p_type").alias("version")
    )


def q_mismatch(spark, sf):
    """Part names whose type differs between brands."""
    return plain(op.version_mismatch(_part_versions(spark, sf)))


def q_mismatch_versions(spark, sf):
    return op.mismatch_versions(_part_versions(spark, sf))


# --- ages and drift --------------------------------------------------------


def q_stale(spark, sf):
    """Customers whose last order lies far back, as of the last order of all."""
    day = F.datediff("o_orderdate", F.lit("1970-01-01").cast("date"))
    orders = inputs.read(spark, sf, "orders").select("o_custkey", day.alias("day"))
    last_day = orders.agg(F.max("day")).first()[0] or 0

    def midnight(days: Column) -> Column:
        return F.timestamp_seconds(days.cast("bigint") * 86_400)

    last = orders.groupBy(F.col("o_custkey").cast("string").alias("path")).agg(midnight(F.max("day")).alias("mtime"))
    files = last.withColumn("project", F.lit("customers"))
    return plain(op.stale(files, midnight(F.lit(last_day))))


def q_stale_code(spark, sf):
    return plain(op.stale(inputs.code(spark, sf), inputs.as_of()))


def q_drift(spark, sf):
    """Mean order price per customer, before and after the middle of the period."""
    orders = inputs.read(spark, sf, "orders")
    split = F.lit("1996-01-01").cast("date")
    date = F.col("o_orderdate").cast("date")

    def period(rows: DataFrame) -> DataFrame:
        return (
            rows.groupBy("o_custkey")
            .agg(F.avg("o_totalprice").alias("mean_price"))
            .select(
                "o_custkey",
                (F.col("mean_price") / 500000.0).alias("score"),
                F.when(F.col("mean_price") > 250000, "high").otherwise("low").alias("label"),
            )
        )

    before = period(orders.where(date < split))
    after = period(orders.where(date >= split))
    out = op.drift(after, before, "o_custkey", "score", "label")
    return out.select(
        "compared",
        "baseline_rows",
        "changed_labels",
        F.round("mean_change", 6).alias("mean_change"),
        F.round("max_change", 6).alias("max_change"),
        "moved_keys",
        F.round("label_share", 6).alias("label_share"),
        "status",
    )


# --- whole audit and reports -----------------------------------------------


def audit_files(spark: SparkSession, sf: str) -> DataFrame:
    """CODE, and DOC as configuration files of projects of their own."""
    docs = inputs.documents(spark, sf).withColumn("path", F.concat("path", F.lit(".yaml")))
    return inputs.code(spark, sf).unionByName(docs)


def audit_projects(files: DataFrame) -> DataFrame:
    registry = inputs.code_projects(files)
    languages = F.when(F.col("name").startswith("src"), F.array(F.lit("python"))).otherwise(F.col("languages"))
    return registry.withColumn("languages", languages)


def audit_inputs(spark: SparkSession, sf: str) -> AuditInputs:
    files = audit_files(spark, sf)
    return AuditInputs(
        files,
        audit_projects(files),
        inputs.as_of(),
        secret_rules=[*SECRET_RULES, USER_SECRET],
    )


def found(spark: SparkSession, sf: str) -> DataFrame:
    return audit(audit_inputs(spark, sf))


def found_once(spark: SparkSession, sf: str) -> DataFrame:
    """The findings as a table, for reports that read them more than once."""
    return stage(found(spark, sf), "findings")


def scanned(spark: SparkSession, sf: str) -> DataFrame:
    files = audit_files(spark, sf)
    return present_projects(files, audit_projects(files))


def q_audit(spark, sf):
    return plain(found(spark, sf))


def q_summary(spark, sf):
    return report.project_summary(found(spark, sf), scanned(spark, sf))


def q_status(spark, sf):
    return report.status(q_summary(spark, sf)).select("project", "status")


def q_totals(spark, sf):
    return report.report_totals(found(spark, sf), scanned(spark, sf))


def q_check_counts(spark, sf):
    return report.check_counts(found(spark, sf))


def q_gate(spark, sf):
    return report.gate(found(spark, sf))


def q_head(spark, sf):
    head = report.head_findings(found_once(spark, sf))
    return head.select(
        "project", "check", F.col("rank").cast("bigint").alias("rank"), "severity", "file", "message", "more"
    )


def q_critical(spark, sf):
    top = report.critical_top(found_once(spark, sf))
    return top.select("project", "file", F.col("line").cast("bigint").alias("line"), "check", "message", "more")


def q_alert(spark, sf):
    return report.alert_lines(found_once(spark, sf), RUN_DATE)


def q_digest(spark, sf):
    rows = found_once(spark, sf)
    projects = scanned(spark, sf)
    summary = report.project_summary(rows, projects)
    return report.digest_lines(rows, summary, report.report_totals(rows, projects), RUN_DATE)


def q_quarantine(spark, sf):
    """The audit of hostile files: what gave a warning in place of a check, and what was found still."""
    files = inputs.hostile(spark, sf)
    settings = AuditInputs(files, inputs.code_projects(files), inputs.as_of(), secret_rules=USER_PATTERNS)
    rows = audit(settings)
    reason = (
        F.when(F.col("message").startswith("Check skipped"), "skipped")
        .when(F.col("message").startswith("Check failed"), "failed")
        .when(F.col("message").startswith("File not checked"), "not checked")
        .when(F.col("message").startswith("Potential hardcoded secret"), "found")
    )
    return rows.select("project", "file", "check", "severity", reason.alias("reason")).where("reason IS NOT NULL")


def long_lines(path: str, text: str):
    """A user's own check: every line of a script that is longer than 2,000 characters."""
    if path.endswith(".ts"):
        for number, line in enumerate(text.split("\n"), 1):
            if len(line) > 2_000:
                yield "info", number, f"Line of {len(line)} characters"


def q_user_check(spark, sf):
    files = inputs.code(spark, sf)
    register_check("long_lines", file_check("long_lines", long_lines))
    try:
        return plain(audit(AuditInputs(files, inputs.code_projects(files), inputs.as_of()), check="long_lines"))
    finally:
        CHECKS.pop("long_lines")


def q_report(spark, sf):
    """The totals of two days as read back; the first day's second run found nothing."""
    folder = f"{staging_dir(spark)}/reports-{uuid.uuid4().hex}"
    rows = stage(audit(audit_inputs(spark, sf), check="security_scan"), "findings")
    projects = scanned(spark, sf)
    report.write_report(rows, projects, folder, RUN_DATE)
    report.write_report(rows.limit(0), projects, folder, RUN_DATE)
    report.write_report(rows, projects, folder, "2024-01-02")
    found_rows = report.read_report(spark, folder).groupBy("run_date").agg(F.count(F.lit(1)).alias("n_findings"))
    totals = report.read_report(spark, folder, "totals")
    return totals.join(found_rows, "run_date", "left").na.fill(0)


def q_stream(spark, sf):
    """Duplicate functions after two batches of a stream, a changed and a removed file among them.

    The first batch has older versions of some files and lacks some projects.
    """
    folder = f"{staging_dir(spark)}/stream-{uuid.uuid4().hex}"
    files = inputs.code(spark, sf).select("project", "path", "size", "mtime", "content")
    late, changed = F.col("project").endswith("7"), F.col("project").endswith("1") & F.col("path").contains("dup")
    older = F.when(changed, F.concat(F.lit(inputs.OLDER), "content")).otherwise(F.col("content"))
    settings = AuditInputs(files, inputs.code_projects(files), inputs.as_of())
    for batch in (files.where(~late).withColumn("content", older), files.where(late | changed)):
        batch.write.mode("append").parquet(f"{folder}/files")
        arriving = spark.readStream.schema(files.schema).parquet(f"{folder}/files")
        run = audit_stream(arriving, settings, f"{folder}/state", f"{folder}/progress", checks=["duplicate_code"])
        run.awaitTermination()
    removed = F.col("project").endswith("3") & F.col("path").contains("dup")
    listing = files.where(~removed).select("project", "path")
    return plain(audit_so_far(spark, settings, f"{folder}/state", check="duplicate_code", listing=listing))


QUERIES = {name: fn for name, fn in list(globals().items()) if name.startswith("q_")}
