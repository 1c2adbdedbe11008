"""Sources: directory trees, ignore globs, size caps, the registry."""

import fnmatch
import json
import os
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from sievework.sources import (
    filter_ext,
    filter_ignored,
    large_files,
    path_ignored,
    present_projects,
    read_corpus,
    read_projects,
    read_text,
    select_projects,
)
from sievework.sources import corpus, read_secret_rules, scan_corpus
from sievework.rules import SECRET_RULES


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "proj"
    for name, data in {
        "__init__.py": b"",
        ".gitignore": b".env\n",
        "a b.py": b"x = 1\r\ny = 2\r",
        "bad.py": b"ok \xff\xfe end",
        "src/deep/er/m.ts": b"export const a = 1",
        "node_modules/x/index.js": b"eval(1)",
        "big.py": b"#" * 2000,
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    os.symlink(root / "src", root / "link")
    return root


@pytest.mark.parametrize("limit", [1, 100])
def test_corpus_lists_hidden_and_empty_files(spark, tree, limit):
    projects = [
        {"name": "p", "path": str(tree), "ignore_patterns": ["node_modules"]},
        {"name": "gone", "path": str(tree / "nowhere"), "ignore_patterns": []},
    ]
    rows = {r.path: r for r in read_corpus(spark, projects, max_size=1000, limit=limit).collect()}
    assert sorted(rows) == [".gitignore", "__init__.py", "a b.py", "bad.py", "big.py", "src/deep/er/m.ts"]
    assert rows["__init__.py"].content == "" and rows["bad.py"].content == "ok  end"
    assert rows["big.py"].content is None and rows["big.py"].size == 2000
    assert rows["a b.py"].mtime.timestamp() == pytest.approx(os.stat(tree / "a b.py").st_mtime, abs=1)


def test_corpus_without_content(spark, tree):
    rows = read_corpus(spark, [{"name": "p", "path": str(tree)}], read_content=False)
    assert rows.where("content is not null").count() == 0
    assert [r.path for r in large_files(rows, 1999).collect()] == ["big.py"]


def test_reading_is_split_by_bytes(spark, tmp_path):
    """70 projects, one with most of the files in one flat folder, one with a large file."""
    names = []
    for p in range(70):
        for i in range(1500 if p == 3 else 5):
            path = tmp_path / f"p{p}" / ("flat" if p == 3 else f"d{i}") / f"f{i}.py"
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(b"x" * (i % 50 * 100))
            names.append((f"p{p}", str(path.relative_to(tmp_path / f"p{p}"))))
    projects = [{"name": f"p{p}", "path": str(tmp_path / f"p{p}")} for p in range(71)]
    registry = spark.createDataFrame([(p["name"], p["path"], None) for p in projects], "name string, path string, ignore_patterns array<string>")
    listing, roots = corpus.list_corpus(spark, registry, limit=200)
    assert sorted((r.project, r.path) for r in listing.collect()) == sorted(names)
    assert roots.count() == 70
    placed, n = corpus.byte_parts(listing, 16)
    cost = [r[0] for r in placed.groupBy("part").agg(F.sum(F.col("size") + corpus.FILE_COST)).select("sum((size + 4096))").collect()]
    assert n == 16 and len(cost) == 16 and max(cost) < 1.2 * sum(cost) / 16
    files = read_corpus(spark, projects, parts=16)
    rows = files.select("project", "path", F.length("content").alias("n"), F.spark_partition_id().alias("task")).collect()
    assert sorted((r.project, r.path) for r in rows) == sorted(names)
    assert len({r.task for r in rows if r.project == "p3"}) >= 8
    assert all(r.n == int(r.path.split("/f")[1][:-3]) % 50 * 100 for r in rows)


def test_a_folder_without_files_counts_as_scanned(spark, tmp_path):
    from sievework.plans import report
    from sievework.plans.audit import AuditInputs, audit

    for name in ("full", "empty"):
        (tmp_path / name).mkdir()
    (tmp_path / "full" / "a.py").write_text('k = "tok-0123456789abcdef"\npassword = "abcDEF123456"\n')
    config = tmp_path / "config.json"
    registry = [{"name": n, "path": str(tmp_path / n), "languages": ["python"]} for n in ("full", "empty", "gone")]
    config.write_text(json.dumps({"projects": registry, "secret_patterns": [r"tok-[0-9a-f]{16}", "(bad", SECRET_RULES[0].pattern]}))
    inputs = AuditInputs.from_config(spark, str(config), F.lit("2024-01-01").cast("timestamp"))
    assert sorted(r.name for r in present_projects(inputs.files, inputs.projects, inputs.roots).collect()) == ["empty", "full"]
    found = audit(inputs, check="security_scan").collect()
    secrets = [(r.file, r.line) for r in found if r.message.startswith("Potential hardcoded")]
    assert sorted(secrets) == [("full/a.py", 1), ("full/a.py", 2)]
    assert any("(bad" in r.message for r in found)
    summary = report.project_summary(audit(inputs, check="security_scan"), present_projects(inputs.files, inputs.projects, inputs.roots))
    assert {r.project for r in summary.collect()} == {"empty", "full"}


def reference_ignored(path, globs):
    def tested(p):
        return any(
            fnmatch.fnmatchcase(p, g) or any(fnmatch.fnmatchcase(c, g) for c in PurePosixPath(p).parts) for g in globs
        )

    parts = path.split("/")
    above = ["/".join(parts[:i]) for i in range(1, len(parts))]
    return tested(path) or any(tested(f"./{a}" if "/" not in a else a) for a in above)


def test_ignore_globs_follow_shell_rules(spark):
    paths = [
        "a.py", "node_modules/x.js", "src/node_modules/y/z.js", "src/gen/a.py", "src/genx/a.py", "d/e/f.md",
        ".git/config", "x[1].py", "a+b/c.py", "deep/a/b/c.txt", "build", "src/.hidden/a", "ab/c", "Dist/a",
    ]
    globs = ["node_modules", "*.md", "src/gen", ".*", "x[[]1].py", "a+b", "deep/*/c.txt", "b?ild", "[!a-z]ist", "./ab"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    for g in [[x] for x in globs] + [globs]:
        got = {r.p: r.v for r in rows.select("p", path_ignored(F.col("p"), g).alias("v")).collect()}
        assert got == {p: reference_ignored(p, g) for p in paths}, g


def test_each_project_has_its_own_globs(spark, files, projects):
    registry = projects("p", ignore=["a"]).unionByName(projects("q", ignore=["b"])).unionByName(projects("r", ignore=[]))
    rows = files(*[(p, f, "") for p in "pqr" for f in ("a/x", "b/x")])
    assert sorted((r.project, r.path) for r in filter_ignored(rows, registry).collect()) == [
        ("p", "b/x"), ("q", "a/x"), ("r", "a/x"), ("r", "b/x"),
    ]


def test_suffixes_and_caps(files):
    rows = files(("p", "a.py", "12345"), ("p", "b.PY", "x"), ("p", "c.py", ""), ("p", "d.py", "é" * 3))
    assert {r.path for r in filter_ext(rows, [".py"]).collect()} == {"a.py", "c.py", "d.py"}
    assert filter_ext(rows, []).count() == 4
    assert {r.path for r in read_text(rows, max_size=5).collect()} == {"a.py", "b.PY"}
    assert read_text(rows, max_size=6, keep_empty=True).count() == 4


def test_read_text_decodes_bytes(spark):
    rows = spark.createDataFrame([("p", "a", 9, bytearray(b"ok \xff\r\nx"))], "project string, path string, size bigint, content binary")
    assert read_text(rows).first().content == "ok \nx"


def test_registry(spark, tmp_path, files):
    path = tmp_path / "config.json"
    path.write_text(json.dumps({
        "projects": [
            {"name": "a", "path": "/a", "languages": ["python"], "ignore_patterns": ["x"], "supabase_project": "s"},
            {"name": "b", "path": "/b", "languages": []},
        ],
        "secret_patterns": ["k+", "(bad"],
    }))
    registry = read_projects(spark, str(path))
    assert [(r.name, r.languages, r.supabase_project) for r in registry.orderBy("name").collect()] == [
        ("a", ["python"], "s"), ("b", [], None),
    ]
    assert [r.pattern for r in read_secret_rules(spark, str(path))] == ["k+", "(bad"]
    assert [r.name for r in select_projects(registry, "b").collect()] == ["b"]
    with pytest.raises(ValueError):
        select_projects(registry, "zzz")
    assert select_projects(registry, "zzz", strict=False).count() == 0
    assert [r.name for r in present_projects(files(("a", "f", "")), registry).collect()] == ["a"]


def test_every_project_may_have_its_own_ignore_list(spark, files):
    n = 2_000
    registry = spark.createDataFrame(
        [(f"p{i}", None, ["python"], [f"only{i}.py", "[0-"]) for i in range(n)] + [("bare", None, None, None)],
        "name string, path string, languages array<string>, ignore_patterns array<string>",
    )
    rows = files(*[(f"p{i}", f"only{i - i % 2}.py", "") for i in range(n)], ("bare", "only0.py", ""))
    left = filter_ignored(rows, registry)
    assert left.count() == n // 2 + 1 and left.where("project = 'p0'").count() == 0
