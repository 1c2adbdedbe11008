"""Exports, imports, functions, duplicates: worked-out cases and brute force."""

import ast

from pyspark.sql import functions as F

from sievework import operators as op
from sievework.operators.extract import guarded, python_shape, read_js, read_python
from sievework.operators.usage import uncalled
from sievework.plans.scale import likely_among


def sites(df):
    return sorted((r.file, r.line, r.message) for r in df.collect())


def test_unused_exports(files):
    rows = files(
        ("p", "a.ts", "export function used() {}\n\nexport default class Gone {}\nexport const GET = 1\nexport { x }"),
        ("p", "b.ts", "import { used, Gone as Alias } from './a'\nimport * as all from 'z'"),
        ("p", "page.tsx", "export const Page = 1"),
        ("q", "c.js", "export async function used() {}"),
        ("q", "d.py", "export const notjs = 1"),
    )
    names = [(f, m.split("'")[1]) for f, _, m in sites(op.unused_exports(rows))]
    assert names == [("q/c.js", "used")]
    strict = [(f, line, m.split("'")[1]) for f, line, m in sites(op.unused_exports(rows, strict=True))]
    assert strict == [("p/a.ts", 3, "Gone"), ("q/c.js", 1, "used")]


def test_rows_whose_keys_may_be_wanted(spark):
    rows = spark.range(20_000).select((F.col("id") % 3).alias("p"), F.concat(F.lit("n"), "id").alias("name"), "id")
    rows = rows.unionByName(spark.createDataFrame([(None, "n1", -1), (1, None, -2)], "p bigint, name string, id bigint"))
    wanted = rows.where("id % 100 = 7 OR id = -1").select("p", "name")
    got = {r.id for r in likely_among(rows, wanted, ["p", "name"]).collect()}
    want = {i for i in range(20_000) if i % 100 == 7} | {-1}
    assert want <= got and len(got) <= len(want) + 5
    crowded = {r.id for r in likely_among(rows, wanted, ["p", "name"], bits=64).collect()}
    assert want <= crowded
    assert likely_among(rows, wanted.where("false"), ["p", "name"]).collect() == []
    assert likely_among(rows.where("false"), wanted, ["p", "name"]).columns == rows.columns


def test_calls_of_names_not_defined_do_not_move(spark):
    defined = spark.createDataFrame([("p", "a.py", f"f{i}", i) for i in range(50)], "project string, path string, name string, line int")
    called = [("p", f"f{i}") for i in range(0, 50, 2)] + [("p", f"other{i}") for i in range(5000)] + [("q", "f1")] * 3
    calls = spark.createDataFrame(called, "project string, name string")
    assert sorted(r.line for r in uncalled(defined, calls).collect()) == list(range(1, 50, 2))
    assert likely_among(calls, defined, ["project", "name"]).count() <= 25 + 2


def test_unused_imports(files):
    text = (
        "from __future__ import annotations\nimport os.path\nimport re, json as j\nfrom x import *\n"
        "import _side\nfrom y import a, b\n__all__ = ['b']\nos.sep\ndef f():\n    import re\n"
    )
    rows = files(("p", "a.py", text), ("p", "b.py", "import os\nthis is no python"))
    assert [(line, m) for _, line, m in sites(op.unused_imports(rows))] == [
        (3, "Unused import: j"), (6, "Unused import: a"), (10, "Unused import: re"),
    ]
    assert (2, "Unused import: os.path") in [(line, m) for _, line, m in sites(op.unused_imports(rows, strict=True))]


def test_unused_functions(files):
    text = (
        "def lonely():\n    pass\n@deco\ndef kept():\n    pass\ndef test_x():\n    pass\ndef __dunder():\n    pass\n"
        "def called():\n    pass\nasync def elsewhere():\n    pass\nclass C:\n    def method(self): pass\nx = called\n"
    )
    rows = files(("p", "a.py", text), ("p", "b.py", "elsewhere (1)"), ("q", "c.py", "lonely()"))
    assert [(line, m.split(": ")[1].split("(")[0]) for _, line, m in sites(op.unused_functions(rows))] == [(1, "lonely")]
    assert sites(op.unused_functions(rows, strict=True)) == []


def test_extraction_failure_becomes_an_error():
    assert guarded(lambda text: 1 / 0)("x") == {"error": "ZeroDivisionError: division by zero"}
    assert guarded(lambda text: 1 / 0)("") is None
    assert guarded(read_python)("x = " + "(" * 10_000) is None or "error" in guarded(read_python)("x = " + "(" * 10_000)


def shape(text):
    return python_shape(ast.parse(text).body[0])


def test_python_shape():
    base = "def f(a, b):\n    c = a + b\n    for x in c:\n        g(x, k=1)\n    return 'x'"
    assert shape(base) == shape(
        "@deco\nasync def other(p, q, *, z=3):\n    r = p + q\n    for s in r:\n        h(s, w=2)\n    return 'y'"
    )
    for changed in (
        base.replace("a + b", "b + a"), base.replace("a + b", "a - b"), base.replace("'x'", "1"),
        base.replace("return", "yield"), base.replace("g(x", "g.m(x"), base.replace("g(x, k=1)", "g(x, x)"),
    ):
        assert shape(base) != shape(changed)
    assert shape(base.replace("g(x, k=1)", "g.m(x)")) != shape(base.replace("g(x, k=1)", "g.n(x)"))


def test_js_blocks():
    text = (
        "async function a({x}) {\n 1\n 2\n 3\n 4\n}\nconst b = (q) => {\n '}'\n `{`\n 3\n 4\n}\nconst c = x => x\n"
        "function open() {\n {\n 1\n 2\n 3\n 4\n"
    )
    got = read_js(text)["blocks"]
    # The parameter pattern is the first brace of a(), so its block is too short.
    assert [(b["name"], b["line"], b["n_lines"]) for b in got] == [("b", 7, 5)]
    assert got[0]["block"].startswith("{\n '}'") and got[0]["block"].endswith("4\n}")


def body(name, extra=""):
    return f"def {name}(a):\n    b = a\n    c = b\n    d = c\n    e = d\n{extra}    return e\n\n"


def groups(functions):
    return {r.site.name: (r.n, r.cross_project) for r in op.duplicate_groups(functions).collect()}


def test_duplicate_groups_need_two_places_or_three_copies(files):
    two = body("a") + body("b")
    assert groups(op.py_functions(files(("p", "x.py", two)))) == {}
    assert groups(op.py_functions(files(("p", "x.py", two + body("c"))))) == {"a": (3, False)}
    assert groups(op.py_functions(files(("p", "x.py", body("a")), ("p", "y.py", body("b"))))) == {"a": (2, False)}
    assert groups(op.py_functions(files(("p", "x.py", body("a")), ("q", "y.py", body("b"))))) == {"a": (2, True)}


def test_groups_of_any_size_keep_their_count_and_their_sites(files, spark):
    rows = files(*[("p" if i % 3 else "hot", f"{i}.py", body(f"f{i}")) for i in range(30)])
    copies = spark.range(170).withColumnRenamed("id", "copy")
    functions = op.py_functions(rows).crossJoin(copies).withColumn("line", F.col("copy") + 1).drop("copy")
    found = op.duplicate_groups(functions)
    row = found.first()
    assert (row.n, row.cross_project) == (5100, True)
    assert op.duplicate_sites(functions, found).count() == 5100


def test_duplicate_message_names_the_first_site(files):
    rows = files(("q", "b.py", body("two")), ("p", "a.py", body("one")))
    got = op.duplicate_findings(op.duplicate_groups(op.py_functions(rows))).first()
    assert (got.file, got.line, got.severity) == ("p/a.py", 1, "warning")
    assert got.message == (
        "Duplicate function structure found in 2 locations (CROSS-PROJECT), first: p/a.py:1 -> one() (5 lines)"
    )
