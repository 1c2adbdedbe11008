"""The whole audit: agreement with the single operators, invariants, reports, streams."""

import datetime as dt
import random
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from sievework import operators as op
from sievework.plans import report
from sievework.plans.audit import CHECKS, AuditInputs, audit, extract_facts, file_check, register_check
from sievework.operators import work
from sievework.rules import WRAPPER_LINEAR, WRAPPER_PATTERN, Rule, java_pattern
from sievework.schema import FINDING_COLUMNS, findings
from sievework.sources import read_corpus
from sievework.streaming import audit_so_far, audit_stream, incremental

AS_OF = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
KEY = "sk-abcdefghij0123456789KLMN"
BODY = "def {}(a):\n    b = a\n    c = b\n    d = c\n    e = d\n    return e\n"

CORPUS = [
    ("p", "a.py", "import os\n" + BODY.format("f") + f"k = '{KEY}'\neval(x)\n"),
    ("p", "b.ts", "export const lonely = 1\nfetch(u)\n"),
    ("p", "node_modules/x.js", "eval(x)"),
    ("p", "package.json", '{"dependencies": {"axios": "0.1"}}'),
    ("p", "conf/x.yaml", f"k: '{KEY}'"),
    ("p", "migrations/1.sql", "CREATE TABLE t (a_id text);"),
    ("q", "z.py", BODY.format("g") + "for x in y:\n    db.query(x)\n", AS_OF - dt.timedelta(days=400)),
    ("q", "big.py", "eval(x)\n" * 100_000),
    ("q", "readme.txt", "eval(x)"),
]


@pytest.fixture
def inputs(spark, files, projects):
    return AuditInputs(files(*CORPUS), projects("p", "q", "absent"), F.lit(AS_OF), max_size=500_000)


def rows(df):
    return sorted(tuple("" if v is None else v for v in r) for r in df.select(*FINDING_COLUMNS).collect())


def keys(df):
    return sorted((r.check, r.file, r.line or 0, r.severity, r.message.split("\n")[0][:40]) for r in df.collect())


def test_audit_finds_what_is_there(inputs):
    got = keys(audit(inputs))
    short = {(check, file, line) for check, file, line, *_ in got}
    assert short == {
        ("duplicate_code", "p/a.py", 2),
        ("security_scan", "p/.gitignore", 0), ("security_scan", "q/.gitignore", 0),
        ("security_scan", "q/big.py", 0), ("security_scan", "p/a.py", 8), ("security_scan", "p/a.py", 9), ("security_scan", "p/conf/x.yaml", 1),
        ("dead_code", "p/a.py", 1), ("dead_code", "p/a.py", 2), ("dead_code", "p/b.ts", 1),
        ("dead_code", "q/z.py", 0), ("dead_code", "q/z.py", 1),
        ("dependency_audit", "p/package.json", 0), ("dependency_audit", "p/package-lock.json", 0),
        ("dependency_audit", "p/requirements.txt", 0), ("dependency_audit", "q/requirements.txt", 0),
        ("performance_lint", "p/b.ts", 2), ("performance_lint", "p/migrations/1.sql", 0), ("performance_lint", "q/z.py", 7),
    }


def test_staged_and_unstaged_agree(inputs):
    assert rows(audit(inputs)) == rows(audit(inputs, staged=False))


def test_row_order_and_partitions_do_not_matter(inputs):
    shuffled = replace(inputs, files=inputs.files.orderBy(F.rand(3)).repartition(7))
    assert rows(audit(inputs)) == rows(audit(shuffled))


def test_one_check_or_one_project(inputs):
    everything = audit(inputs)
    for check in CHECKS:
        assert rows(audit(inputs, check=check)) == rows(everything.where(F.col("check") == check)), check
    assert {r.project for r in audit(inputs, project="q").collect()} == {"q"}
    with pytest.raises(ValueError):
        audit(inputs, check="nope")
    with pytest.raises(ValueError):
        audit(inputs, project="nope")


def test_ignoring_a_path_removes_exactly_its_rows(inputs, projects):
    before = audit(inputs, check="performance_lint")
    fewer = replace(inputs, projects=projects("p", "q", ignore=["node_modules", "b.ts"]))
    assert rows(audit(fewer, check="performance_lint")) == rows(before.where("file <> 'p/b.ts'"))


def test_project_without_languages_has_no_suffix_filter(inputs, projects):
    bare = replace(inputs, projects=projects("p", "q", languages=[]))
    got = audit(bare, check="performance_lint")
    assert ("performance_lint", "p/b.ts", 2) in {k[:3] for k in keys(got)}
    assert all(k[0] != "security_scan" or "a.py" not in k[1] for k in keys(audit(bare, check="security_scan")))


def test_copying_a_corpus_makes_every_group_cross_project(inputs, files, projects):
    one = [r for r in CORPUS if r[0] == "p"] + [("p", "copy.py", BODY.format("h"))]
    both = files(*one, *[("r", *r[1:]) for r in one])
    got = audit(replace(inputs, files=both, projects=projects("p", "r")), check="duplicate_code")
    assert {r.severity for r in got.collect()} == {"warning"}


def test_users_can_register_a_check(inputs):
    def long_names(i):
        return findings(i.kind("export"), check="long_names", severity="info", file=F.col("path"), message=F.col("name"))

    register_check("long_names", long_names)
    try:
        assert audit(inputs).where("check = 'long_names'").count() == 1
    finally:
        del CHECKS["long_names"]


def test_a_check_of_single_files(spark, inputs):
    def scan(path, text):
        yield "info", 1, f"{path} has {len(text)} characters"
        if path.endswith(".ts"):
            raise KeyError("no")

    register_check("sizes", file_check("sizes", scan))
    try:
        got = {(r.file, r.severity, r.line, r.message) for r in audit(inputs, check="sizes").collect()}
    finally:
        del CHECKS["sizes"]
    assert ("p/b.ts", "warning", None, "Check failed with error: KeyError: 'no'") in got
    assert ("q/readme.txt", "info", 1, "readme.txt has 7 characters") in got
    assert not any("node_modules" in f for f, *_ in got) and len(got) == len(CORPUS)


def test_states_of_batches_merge_into_the_groups_of_all_files(spark, tmp_path):
    """New, changed and removed files in any order of batches against counting again."""
    rng = random.Random(12)
    folder, now = str(tmp_path / "state"), {}
    facts_schema = "project string, path string, severity string, check string, line int, message string, snippet string, name string, value string, num int"
    for number in range(4):
        paths = {(rng.choice("pq"), f"f{rng.randint(0, 25)}") for _ in range(12)}
        batch = {p: [f"fp{rng.randint(0, 9)}" for _ in range(rng.randint(0, 3))] for p in paths}
        now.update({p: (number, fps) for p, fps in batch.items()})
        rows = [(*p, None, None, i, None, None, f"n{i}", fp, 6) for p, fps in batch.items() for i, fp in enumerate(fps)]
        spark.createDataFrame(rows, facts_schema).write.parquet(f"{folder}/facts/batch={number}/kind=function")
        files = spark.createDataFrame(sorted(paths), "project string, path string")
        seen = files.select("project", "path", F.lit(1).cast("bigint").alias("size"), F.lit(None).cast("timestamp").alias("mtime"), incremental._bucket("project", "path").alias("bucket"))
        seen.write.partitionBy("bucket").parquet(f"{folder}/files/batch={number}")
        incremental.update_groups(spark, folder, number, files)
    removed = [p for p in sorted(now) if rng.random() < 0.3]
    gone = spark.createDataFrame([(*p, now[p][0]) for p in removed], "project string, path string, batch bigint")
    for left_out, frame in (([], None), (removed, gone)):
        sites = [(*p, f"n{i}", i, fp, 6) for p, (_, fps) in now.items() if p not in left_out for i, fp in enumerate(fps)]
        functions = spark.createDataFrame(sites, "project string, path string, name string, line int, fp string, n_lines int")
        want = sorted(map(tuple, op.duplicate_groups(functions).collect()))
        assert sorted(map(tuple, incremental.groups_so_far(spark, folder, frame).collect())) == want and want


def test_extraction_has_no_shuffle_but_the_registry_join_is_broadcast(inputs):
    plan = extract_facts(inputs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan and "Exchange range" not in plan and "BroadcastHashJoin" in plan
    assert plan.count("Scan") == 2  # the files once, the registry once


def test_reports(inputs):
    found = audit(inputs)
    scanned = inputs.projects.where("name <> 'absent'").unionByName(inputs.projects.where("name = 'absent'"))
    summary = {r.project: r for r in report.project_summary(found, scanned).collect()}
    totals = report.report_totals(found, scanned).first()
    assert summary["absent"].total == 0 and totals.projects_scanned == 3
    between = found.where("project is null").count()
    assert totals.total == sum(r.total for r in summary.values()) + between and between == 1
    assert {r.project: r.status for r in report.status(report.project_summary(found, scanned)).collect()} == {
        "absent": "CLEAN", "p": "CRITICAL", "q": "WARNINGS",
    }
    assert report.gate(found).first().failed is True
    assert report.gate(found.where("severity = 'info'")).first().failed is False
    assert report.gate(found.limit(0)).first().failed is False


def test_head_and_top_lists(spark):
    data = [("p", "critical" if i < 12 else "info", "c", f"p/{i:02d}", i, f"m{i}", None) for i in range(14)]
    found = spark.createDataFrame(data, "project string, severity string, check string, file string, line int, message string, snippet string")
    head = report.head_findings(found).orderBy("rank").collect()
    assert [(r["rank"], r.file, r.more) for r in head] == [(i + 1, f"p/{i:02d}", 9) for i in range(5)]
    top = report.critical_top(found).orderBy("file").collect()
    assert [r.file for r in top] == [f"p/{i:02d}" for i in range(10)] and {r.more for r in top} == {2}
    text = [r.text for r in report.alert_lines(found, "2024-01-01").orderBy("section", "pos").collect()]
    assert text[0] == "QA ALERT: 12 critical issues found (2024-01-01)" and text[1] == ""
    assert text[2] == "- [c] p/00: m0" and text[12] == "... and 2 more" and text[13].startswith("\nFull report: /tmp/")
    plan = report.head_findings(found)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_sinks(inputs, tmp_path, spark):
    found = audit(inputs, check="security_scan")
    folder = str(tmp_path / "reports")
    for _ in range(2):
        report.write_report(found, inputs.projects, folder, "2024-01-01")
    report.write_report(found.where("severity = 'critical'"), inputs.projects, folder, "2024-01-02")

    def days(name="findings"):
        return {r.run_date: r["count"] for r in report.read_report(spark, folder, name).groupBy("run_date").count().collect()}

    first = days()
    assert first["2024-01-01"] == found.count() > first["2024-01-02"] > 0
    assert days("totals") == {"2024-01-01": 1, "2024-01-02": 1}
    totals = {r.run_date: r.total for r in report.read_report(spark, folder, "totals").collect()}
    assert totals == first
    # A run that fails half way is not seen, nor is one before its commit.
    broken = found.withColumn("message", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        report.write_report(broken, inputs.projects, folder, "2024-01-01")
    found.limit(1).write.json(f"{folder}/findings/run_date=2024-01-01/run=later")
    assert days() == first
    report.write_report(found.limit(0), inputs.projects, folder, "2024-01-01")
    assert days() == {"2024-01-02": first["2024-01-02"]}
    assert report.read_report(spark, folder, "totals").where("run_date = '2024-01-01'").first().total == 0
    assert report.read_report(spark, folder, "summary").where("run_date = '2024-01-02'").count() == inputs.projects.count()
    alert = str(tmp_path / "alert")
    assert report.write_alert(found.where("severity = 'info'"), alert, "d") is None
    assert report.write_alert(found, alert, "d") == alert
    lines = [r.value for r in spark.read.text(alert).collect()]
    assert lines[0].startswith("QA ALERT") and any("p/a.py" in line for line in lines)


def test_stream_agrees_with_the_full_audit(spark, inputs, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    schema = inputs.files.schema

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        audit_stream(stream, inputs, sink, str(tmp_path / "chk")).awaitTermination()

    first = inputs.files.where("project = 'p'")
    old = first.where("path = 'a.py'").withColumn("content", F.lit("eval(old)\n"))
    first.where("path <> 'a.py'").unionByName(old).write.parquet(source)
    run()
    inputs.files.where("project = 'q' or path = 'a.py'").write.mode("append").parquet(source)
    run()
    run()
    assert rows(audit_so_far(spark, inputs, sink)) == rows(audit(inputs))
    later = replace(inputs, as_of=inputs.as_of + F.expr("INTERVAL 900 DAYS"))
    assert rows(audit_so_far(spark, later, sink)) == rows(audit(later))
    gone = inputs.files.where("path <> 'a.py'")
    listing = gone.select("project", "path")
    assert rows(audit_so_far(spark, inputs, sink, listing=listing)) == rows(audit(replace(inputs, files=gone)))


def test_hostile_files_and_rules_do_not_end_the_audit(spark, files, projects, inputs):
    rows_ = files(
        ("p", "migrations/1.sql", "CREATE TABLE a\\E(b (user_id uuid);\nCREATE INDEX i ON a\\E(b (user_id);\n" + "CREATE TABLE x (" * 20_000),
        ("p", "package.json", '{"name": "x", "name": "y", "dependencies": {"lodash": "1.0.0", "lodash": "4.17.11", "z": "20240101123456.0.1"}}'),
        ("p", "a.py", "def f(:\n" + "x = (" * 3_000),
        ("p", "b.js", "function a() {" * 2_000),
        ("p", "requirements.txt", "==\n>=\n\\E=="),
        ("p", "none.py", None),
    )
    got = audit(replace(inputs, files=rows_, projects=projects("p"), secret_rules=[Rule("(unclosed", "m", "warning")])).collect()
    messages = {r.message for r in got}
    assert any("lodash" in m and "CVE" in m for m in messages)
    assert not any("Invalid JSON" in m or "pre-1.0" in m for m in messages)
    assert not any(m.startswith("Foreign key column 'user_id'") for m in messages)
    assert any(m.startswith("Rule left out") for m in messages)


def test_hostile_files_give_a_warning_in_place_of_a_check(spark, files, projects):
    good = "export const used = 1\n"
    rows = files(
        ("p", "a.ts", "import { " * 20_000), ("p", "b.ts", "const a = (" * 20_000), ("p", "c.py", "-" * 20_000 + "1"),
        ("p", "d.ts", "function f() {\n" * 5_000 + "}" * 5_000), ("p", "ok.ts", good), ("p", "e.py", "key-" * 30_000 + "\nkey-7\n"),
        ("p", "f.ts", "import { a } from 'x'\n" * 5_000), ("p", "g.py", "key-1 " + "x" * 90_000),
    )
    user = Rule("key-[0-9]", "found", "warning", of_user=True)
    inputs = AuditInputs(rows, projects("p"), F.lit(AS_OF), secret_rules=[user])
    start = time.time()
    got = audit(inputs).collect()
    assert time.time() - start < 60
    said = {(r.check, r.file, r.message.split(":")[0]) for r in got if r.message.startswith("Check ")}
    assert said == {
        ("dead_code", "p/a.ts", "Check skipped"),
        ("duplicate_code", "p/b.ts", "Check skipped"),
        ("duplicate_code", "p/c.py", "Check failed with error"),
        ("duplicate_code", "p/d.ts", "Check failed with error"),
        *[("security_scan", f"p/{f}", "Check skipped") for f in ("a.ts", "b.ts", "e.py")],
    }
    assert any(r.file == "p/ok.ts" and r.check == "dead_code" for r in got)
    assert sorted((r.file, r.line) for r in got if r.message == "found") == [("p/e.py", 2), ("p/g.py", 1)]


def test_steps_count_heads_times_the_rest(spark):
    text = "import { a" * 3_000
    df = spark.createDataFrame([(text,), (text + "}" + text,), ("import {} " * 3_000,), ("import {",), (None,)], "content string")
    got = [r[0] for r in df.select(work.steps("content", work.IMPORTS)).collect()]
    assert got[0] == 3_000 * 30_000 and got[1] == 2 * got[0] and got[2] < 100_000 and got[3] == 0


def test_wrappers_are_found_alike_without_trying_again(spark):
    rng = random.Random(4)
    bits = ["fetch", "API", "x", "_", " ", "const ", "function ", "async ", "= (", "(", "=async(", "=", "http", "\n", "let "]
    rows = spark.createDataFrame([("".join(rng.choice(bits) for _ in range(rng.randint(2, 14))),) for _ in range(8_000)], "t string")
    both = rows.select("t", *[F.regexp_extract_all("t", F.lit(java_pattern(p)), F.lit(1)).alias(n) for p, n in ((WRAPPER_PATTERN, "a"), (WRAPPER_LINEAR, "b"))])
    assert both.where("a <> b").collect() == [] and both.where("size(a) > 0").count() > 50


def test_hot_keys_give_whole_results(files):
    many = [("hot", f"{i}.ts", f"export const n{i % 50} = 1") for i in range(300)]
    many += [("cold", "a.ts", "import { n1 } from 'x'"), ("hot", "z.ts", "import { n2 } from 'x'")]
    got = op.unused_exports(files(*many))
    assert got.count() == 294 and got.where("message like '%n2\\'%'").count() == 0


def test_large_files_of_a_corpus_are_checked_or_said_to_be_not(spark, projects, tmp_path):
    (tmp_path / "large.py").write_text("x = 1\n" * 100_000 + f"k = '{KEY}'\n")
    listed = [{"name": "p", "path": str(tmp_path)}]
    named = projects("p")

    def found(rows):
        inputs = AuditInputs(rows, named, F.lit(AS_OF))
        return {(r.line, r.message) for r in audit(inputs, check="security_scan").where("file like '%large.py'").collect()}

    assert {line for line, _ in found(read_corpus(spark, listed))} == {100_001}
    assert found(read_corpus(spark, listed, max_size=500_000)) == {(None, "File not checked: its content was not read")}
