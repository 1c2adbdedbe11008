"""Dependencies, layout, clients, ages: thresholds and edge cases."""

import datetime as dt
import time

from pyspark.sql import functions as F

from sievework import operators as op

UTC = dt.timezone.utc
AS_OF = dt.datetime(2024, 1, 1, tzinfo=UTC)


def as_of():
    return F.timestamp_seconds(F.lit(int(AS_OF.timestamp())))


def ago(days):
    return AS_OF - dt.timedelta(days=days)


def rows_of(df):
    return sorted((r.project, r.severity, r.message) for r in df.collect())


def manifest(text, project="p"):
    return (project, "package.json", text)


def test_manifest_validity(files):
    rows = files(
        manifest('{"dependencies": {"a": "1"}, "devDependencies": {"a": "2", "b": "3"}, "engines": {}}', "ok"),
        manifest('{"dependencies": {"a": "1"}', "cut"),
        manifest('{"a": 1} trailing', "tail"),
        manifest('{"a": 1}, {"b": 2}', "two"),
        manifest("[1]", "list"),
        manifest('{"dependencies": {"a": 4, "b": "1"}}', "number"),
        manifest('{"dependencies": ["a"]}', "section"),
        manifest("", "empty"),
    )
    m = op.js_manifest(rows)
    assert {(r.project, r.name, r.version) for r in op.js_deps(m).collect()} == {
        ("ok", "a", "2"), ("ok", "b", "3"), ("number", "b", "1"),
    }
    assert {(r.project, r.name, r.version) for r in op.js_deps(m, "dependencies").collect()} >= {("ok", "a", "1")}
    got = {(r.project, r.message.split(":")[0]) for r in op.manifest_findings(m).collect()}
    assert got == {(p, "Invalid JSON in package.json") for p in ("cut", "tail", "two")} | {
        (p, "Check failed with error") for p in ("list", "number", "section")
    }
    assert {r.project for r in op.missing_key(m).collect()} == {"number"}


def test_requirements(files):
    text = "# c\n\nDjango == 3.2\nflask>=1.0,<2\nnumpy<2\n-e .\nrequests~=2.0\nextra[x] ; marker\nDJANGO==4.0\nnumpy\n==x"
    got = {(r.name, r.version) for r in op.py_requirements(files(("p", "requirements.txt", text))).collect()}
    assert got == {
        ("django", "4.0"), ("flask", "1.0,<2"), ("numpy", "unpinned"), ("requests~", "unpinned"),
        ("extra[x] ; marker", "unpinned"), ("", "x"),
    }


def test_unpinned_lists_the_first_ten_in_file_order(files):
    text = "\n".join(f"pkg{c}" for c in "zyxwvutsrqpo") + "\npkgz==1"
    got = op.unpinned(op.py_requirements(files(("p", "requirements.txt", text)))).first()
    assert got.message.endswith(": " + ", ".join(f"pkg{c}" for c in "yxwvutsrqp"))


def test_tracked_versions_use_a_second_dialect(files):
    rows = files(
        manifest('{"dependencies": {"react": "^18", "left-pad": "1"}, "devDependencies": {"express": "4"}}'),
        ("p", "requirements.txt", "Django==3\n# react==9\nflask >= 1\nnumpy\nDjango==4"),
        ("p", "pyproject.toml", "x==1"),
    )
    got = {(r.name, r.version) for r in op.tracked_versions(rows).collect()}
    assert got == {("react", "^18"), ("express", "4"), ("Django", "4"), ("# react", "9"), ("flask", ">=1")}


def test_python_pins_override_packages_of_the_same_name(files):
    rows = files(manifest('{"dependencies": {"express": "4"}}'), ("p", "requirements.txt", "express==1"))
    assert [(r.name, r.version) for r in op.tracked_versions(rows).collect()] == [("express", "1")]


def test_advisories(spark, files):
    deps = spark.createDataFrame(
        [("p", "javascript", "lodash", "^4.17.15"), ("p", "javascript", "node-fetch", "2.6.1"), ("p", "python", "pillow", "9.1"),
         ("p", "python", "pillow", "unpinned"), ("p", "python", "requests", ">2.25.1"), ("p", "python", "lodash", "4.17.1"),
         ("p", "javascript", "axios", "1.0")],
        "project string, ecosystem string, name string, version string",
    )
    got = op.vulnerable(deps, op.advisory_table(spark))
    assert sorted(m.split(": ")[1].split(" --")[0] for _, _, m in rows_of(got)) == [
        "lodash@4.17.15", "node-fetch@2.6.1", "pillow==9.1",
    ]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan


def test_pre_release(files):
    text = '{"dependencies": {"a": "^0.1", "clsx": "0.2", "b": "00.1", "c": "10.0", "d": "latest"}, "devDependencies": {"e": "0.1"}}'
    got = op.pre_release(op.js_deps(op.js_manifest(files(manifest(text))), "dependencies"))
    assert [m.split(": ")[1].split("@")[0] for _, _, m in rows_of(got)] == ["a", "b"]


def test_lockfile(files):
    deps = '{"dependencies": {"a": "1"}}'
    rows = files(
        manifest(deps, "old"), ("old", "package-lock.json", "{}", ago(90.5)),
        manifest(deps, "new"), ("new", "package-lock.json", "{}", ago(90)),
        manifest(deps, "none"), manifest("{}", "nodeps"), manifest("{", "bad"),
        manifest(deps, "deep"), ("deep", "sub/package-lock.json", "{}", ago(1)),
    )
    got = op.lockfile_check(op.js_manifest(rows), op.root_files(rows), as_of())
    assert rows_of(got) == [
        ("deep", "warning", "No lockfile found -- builds may be non-deterministic"),
        ("none", "warning", "No lockfile found -- builds may be non-deterministic"),
        ("old", "info", "Lockfile is 90 days old -- consider running npm audit / npm update"),
    ]


def test_version_mismatch(spark):
    rows = [("a", "x", "1"), ("b", "x", "^1"), ("a", "y", "1"), ("b", "y", "1"), ("a", "z", "1")]
    rows += [(f"p{i}", "many", str(i % 2)) for i in range(20)]
    versions = spark.createDataFrame(rows, "project string, name string, version string")
    got = {m for _, _, m in [(r.project, r.severity, r.message) for r in op.version_mismatch(versions).collect()]}
    assert got == {
        "Version mismatch for 'x': 2 versions in 2 projects, from 1 to ^1",
        "Version mismatch for 'many': 2 versions in 20 projects, from 0 to 1",
    }
    assert op.mismatch_versions(versions).count() == 22


def test_missing_entries(files, projects):
    rows = files(
        ("none", "x", ""), ("all", ".gitignore", " .env \n.env.local\n.env.production"), ("star", ".gitignore", ".env*"),
        ("wild", ".gitignore", "*.env*\n"), ("void", ".gitignore", None), ("deep", "sub/.gitignore", ".env*"),
    )
    got = op.missing_entries(rows, projects("none", "all", "star", "wild", "void", "deep"))
    assert [(p, m.split(" ")[0]) for p, _, m in rows_of(got)] == [
        ("deep", "No"), ("none", "No"), ("void", ".env"), ("void", ".env.local"), ("void", ".env.production"),
        ("wild", ".env.local"), ("wild", ".env.production"),
    ]


def test_counterpart_and_missing_manifest(files, projects):
    rows = files(
        ("a", ".env", ""), ("b", ".env", ""), ("b", ".env.example", ""), ("c", "sub/.env", ""),
        ("d", "x.py", ""), ("e", "x.py", ""), ("e", "pyproject.toml", ""), ("f", "sub/x.py", ""),
    )
    names = projects(*"abcdef")
    assert [r.file for r in op.missing_counterpart(rows, names).collect()] == ["a/.env.example"]
    assert [r.file for r in op.missing_manifest(rows, names).collect()] == ["d/requirements.txt"]


def test_unindexed_foreign_keys(files):
    text = (
        "create table if not exists Users (id int, org_id UUID, team_id bigint, note_id varchar);\n"
        "CREATE UNIQUE INDEX i ON users USING btree (ORG_ID);\nCREATE INDEX j ON users (team_id, org_id);"
    )
    rows = files(
        ("p", "supabase/migrations/1.sql", text), ("p", "sql/1.sql", text), ("p", "migrations/a/2.sql", "CREATE TABLE t (a_id text);"),
    )
    assert [(r.file, r.message.split("'")[1]) for r in sorted(op.unindexed_fks(rows).collect(), key=lambda r: r.file)] == [
        ("p/migrations/a/2.sql", "a_id"), ("p/supabase/migrations/1.sql", "team_id"),
    ]


def test_client_sprawl_thresholds(files):
    client = "createClient()"
    rows = [("p", f"{i}.ts", client) for i in range(3)] + [("q", f"{i}.ts", client) for i in range(7)]
    got = op.sprawl(files(*rows))
    assert [(r.file, r.message.split("Files: ")[1]) for r in got.collect()] == [("q", "0.ts, 1.ts, 2.ts, 3.ts, 4.ts...")]
    assert op.sprawl_global(op.client_files(files(*rows))).first().message.startswith(
        "Supabase client initialized in 10 files across 2 projects -- "
    )
    assert op.sprawl_global(op.client_files(files(*rows[:5]))).count() == 0
    assert op.sprawl_global(op.client_files(files(*rows[3:]))).count() == 0


def test_wrappers(files):
    text = "async function getAPIdata(x) {}\nconst httpGet = async (u) => u\nlet request = 5\nfunction plain() {}"
    found = op.wrappers(files(*[(p, "a.ts", text) for p in ("p", "q", "r", "s", "t")]))
    assert {r.name for r in found.collect()} == {"getAPIdata", "httpGet"}
    assert op.wrapper_global(found).count() == 1
    assert op.wrapper_global(found.where("project < 't'")).count() == 0
    assert op.wrapper_global(found.where("project < 'r'")).count() == 0


def test_stale_tiers(files):
    rows = files(*[("p", str(d), "", ago(d)) for d in (180, 180.5, 365, 366)])
    assert {r.file: (r.severity, r.message[-8:]) for r in op.stale(rows, as_of()).collect()} == {
        "p/180.5": ("info", "180 days"), "p/365": ("info", "365 days"), "p/366": ("warning", "366 days"),
    }


def test_indexes_of_a_migration_are_read_once(files):
    keys = ", ".join(f"c{i}_id bigint" for i in range(1000))
    text = f"CREATE TABLE t ({keys});\nCREATE INDEX ix ON t (c7_id);\n-- " + "note " * 60_000
    start = time.time()
    found = [r.message.split("'")[1] for r in op.unindexed_fks(files(("p", "migrations/1.sql", text))).collect()]
    assert time.time() - start < 8
    assert found == [f"c{i}_id" for i in range(1000) if i != 7]


def test_drift(spark):
    def table(*rows):
        return spark.createDataFrame(rows, "k int, s double, l string")

    base = table((1, 0.5, "a"), (2, 0.5, "a"), (3, 0.5, "b"))
    status = lambda cur, b=base: op.drift(cur, b, "k", "s", "l").first().status
    assert status(base) == "stable"
    assert status(table((1, 0.5, "b"), (2, 0.5, "a"), (3, 0.5, "b"))) == "drift"
    assert status(table((1, 0.7, "a"), (2, 0.4, "a"), (3, 0.4, "b"))) == "drift"
    assert status(table((1, 0.55, "a"), (2, 0.55, "a"), (3, 0.5, "b"))) == "drift"
    assert status(table((9, 0.1, "z"))) == "stable"
    assert status(base, base.limit(0)) == "no baseline"
