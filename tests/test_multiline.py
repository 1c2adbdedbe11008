"""Whole-text rules: patterns with line numbers, look-ahead, loop bodies."""

import random
import re
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from sievework import operators as op
from sievework.operators.extract import JS_FUNCTION, block_ends, may_hold_functions, read_js, worth_reading_js
from sievework.operators.gaps import chain_spans
from sievework.operators.multiline import TAIL
from sievework.rules import (
    ERROR_RULES,
    EXPENSIVE_RULES,
    INSECURE_RULES,
    LOOP_LINEAR,
    LOOP_RULES,
    N_PLUS_1_RULES,
    PERFORMANCE_RULES,
    SPACE,
    SQL_RULES,
    UNBOUNDED_RULES,
    Rule,
    java_pattern,
)
from sievework.schema import sql_text


def found(df):
    return sorted((r.file, r.line, r.message, r.snippet) for r in df.collect())


def test_match_lines_and_text(files):
    text = "aXa\n\nX b\x01X\nc"
    got = op.multiline_scan(files(("p", "a", text)), [Rule("X[^X]?", "x", "info")])
    assert [(line, snippet) for _, line, _, snippet in found(got)] == [(1, "Xa"), (3, "X "), (3, "X | ")]


def test_matches_agree_with_a_plain_search(files):
    text = "\n".join(("for(" + "y" * (i % 7) + "{ JSON.parse(" if i % 3 else "z") for i in range(60))
    rule = EXPENSIVE_RULES[0]
    expected = [
        (text[: m.start()].count("\n") + 1, m.group(0)[:200].replace("\n", " | "))
        for m in re.finditer(rule.pattern, text)
    ]
    got = op.multiline_scan(files(("p", "a.js", text)), [rule])
    assert [(r.line, r.snippet) for r in sorted(got.collect(), key=lambda r: r.line)] == expected


def test_absence_within_a_distance(files):
    near, far = "q()" + " " * 10 + "stop", "q()" + " " * 11 + "stop"
    got = op.absent_within(files(("p", "near", near), ("p", "far", far)), r"q\(\)", "stop", 10, "m")
    assert [f for f, *_ in found(got)] == ["p/far"]


def test_unbounded_rules(files):
    text = "a.select('*')\nsupabase.from(t).select(x).single()\nc.fetchall() limit LIMIT"
    got = op.multiline_scan(files(("p", "a.js", text)), UNBOUNDED_RULES)
    assert [(line, m[:9]) for _, line, m, _ in found(got)] == [(1, "Unbounded")]


def test_language_gate(files):
    js = "for (x of y) {\n await db.find(x)\n}"
    got = op.multiline_scan(files(("p", "a.js", js), ("p", "a.py", js)), N_PLUS_1_RULES)
    assert [f for f, *_ in found(got)] == ["p/a.js"]


def loops(files, text, path="a.py"):
    return [(r.line, r.snippet) for r in sorted(op.loop_scan(files(("p", path, text)), LOOP_RULES[:1]).collect(), key=lambda r: r.line)]


def test_loop_body_goes_on_while_indented_or_after_a_blank(files):
    assert loops(files, "for x in y:\n    a\n    db.query(x)") == [(1, "for x in y: |     a |     db.query(")]
    assert loops(files, "for x in y:\n    a\nb = 1\ndb.query(x)") == []
    assert [n for n, _ in loops(files, "for x in y:\n    a\n\ndb.query(x)")] == [1]
    assert [n for n, _ in loops(files, "while  True:  \n\tc.execute (x)")] == [1]


def test_loop_search_resumes_after_a_hit(files):
    text = "for a in b:\n  for c in d:\n    x.select(1)\n    x.select(2)\n  for e in f:\n    x.select(3)"
    assert [n for n, _ in loops(files, text)] == [1, 5]


def test_loop_agrees_with_the_pattern_it_stands_for(files):
    pattern = r"(?:for|while)\s+.+:\s*\n(?:\s+.*\n)*?\s+.*\.(?:execute|fetchone|fetchall|select|from_|query)\s*\("
    parts = ["for x in y:", "    while z:", "    a = 1", "", "b = 2", "    q.select(1)", "  # wait for", "x:"]
    texts, state = [], 7
    for _ in range(40):
        text = []
        for _ in range(9):
            state = (state * 1103515245 + 12345) % 2**31
            text.append(parts[(state >> 8) % len(parts)])
        texts.append("\n".join(text))
    got = op.loop_scan(files(*[("p", f"{i}.py", t) for i, t in enumerate(texts)]), LOOP_RULES[:1]).collect()
    expected = sorted(
        (f"p/{i}.py", t[: m.start()].count("\n") + 1) for i, t in enumerate(texts) for m in re.finditer(pattern, t)
    )
    assert sorted((r.file, r.line) for r in got) == expected and expected


def test_loop_over_many_lines_does_not_overflow(files):
    assert [n for n, _ in loops(files, "for x in y:\n" + "    a\n" * 30_000 + "    db.query(x)")] == [1]


def test_performance_scan_does_not_shuffle(files):
    plan = op.multiline_scan(files(("p", "a.py", "x")), PERFORMANCE_RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_anchored_rule_agrees_with_its_pattern(files):
    rule = N_PLUS_1_RULES[0]
    parts = ["for (x of y)", "while(a)(b) {", "{", ") {", "await db.find(x)", "\n", " ", "await q\x03.x.select (", "for()"]
    texts, state = [], 11
    for _ in range(60):
        pieces = []
        for _ in range(14):
            state = (state * 1103515245 + 12345) % 2**31
            pieces.append(parts[(state >> 8) % len(parts)])
        texts.append("".join(pieces) + ("z" * 490 + "await a.find(" if len(texts) % 3 else ""))
    got = op.multiline_scan(files(*[("p", f"{i}.js", t) for i, t in enumerate(texts)]), [rule]).collect()
    expected = sorted(
        (f"p/{i}.js", t[: m.start()].count("\n") + 1, m.group(0)[:200].replace("\n", " | "))
        for i, t in enumerate(texts)
        for m in re.finditer(rule.pattern, t)
    )
    assert sorted((r.file, r.line, r.snippet) for r in got) == expected and expected


def test_anchored_rule_copes_with_one_very_long_line(files):
    text = "for(a){b(c){d}" * 20_000 + "await q.find("
    assert op.multiline_scan(files(("p", "a.js", text)), N_PLUS_1_RULES[:1]).count() == 1


CHAINED = [r for r in PERFORMANCE_RULES if isinstance(r, Rule) and r.chain]


def test_chains_find_what_their_patterns_find():
    rng = random.Random(5)
    bits = [
        "for (", "while(", "for\n (", "x", ") {", ")\n{", ")", "{", "await ", "await\n  ", "db.find(", ".select (", ".from(", "\n", "  ",
        "JSON.parse(", "+= '", ".map(", ".forEach {", "async function ", "=> {", "statSync(", "existsSync (", "z" * 190, "w" * 95,
        "supabase", ".from", "supabase.from(", "supabase . from (t", ").select(", ") .select (", "*)", ".limit(", ".single (", "y" * 60,
    ]
    assert len(CHAINED) == 6
    for rule in CHAINED:
        hits = 0
        for _ in range(30_000):
            text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 25)))
            want = [m.span() for m in re.finditer(rule.pattern, text)]
            assert chain_spans(text, rule.chain) == want, (rule.pattern, text)
            hits += bool(want)
        assert hits > 100


def test_a_chain_rule_shows_line_and_text(files):
    text = "a\nfor (const x of y) {\n  await db.find(x)\n}\nsupabase.from('t')\n .select('*')\n"
    got = op.multiline_scan(files(("p", "a.js", text), ("p", "b.js", None), ("p", "c.js", "")), CHAINED)
    assert [(f, n, s) for f, n, _, s in found(got) if "Supabase .select" not in _] == [
        ("p/a.js", 2, "for (const x of y) { |   await db.find("),
        ("p/a.js", 5, "supabase.from('t') |  .select('*')"),
    ]


def plain_block_end(source, start):
    depth, at = 1, start
    while depth:
        token = re.compile("[{}'\"`]").search(source, at)
        if token is None:
            return None
        at = token.end()
        if token.group() in "{}":
            depth += 1 if token.group() == "{" else -1
        else:
            close = source.find(token.group(), at)
            at = close + 1 if close >= 0 else at
    return at


def test_block_ends_agree_with_reading_from_each_brace():
    rng = random.Random(6)
    for _ in range(20_000):
        source = "".join(rng.choice("{{}}'\"`ab") for _ in range(rng.randint(0, 30)))
        want = {i: plain_block_end(source, i + 1) for i, c in enumerate(source) if c == "{"}
        assert block_ends(source) == {i: e for i, e in want.items() if e is not None}, source


def test_many_nested_functions_end_soon():
    start = time.time()
    source = "function f() {\n" * 20_000 + "\n" * 5 + "}" * 20_000
    with pytest.raises(ValueError, match="nested functions"):
        read_js(source)
    assert len(read_js("function f() {\n" * 300 + "\n" * 5 + "}" * 300)["blocks"]) == 300
    assert time.time() - start < 5


def test_blocks_that_are_too_much_are_not_cut_out_first():
    source = "function f() {\n" * 5_000 + "}" * 5_000
    tracemalloc.start()
    with pytest.raises(ValueError, match="nested functions"):
        read_js(source)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16_000_000


def test_texts_that_are_not_sent_hold_no_function(spark):
    rng = random.Random(8)
    bits = ["function", "func", "=>", "=", ">", "const f", " ", "{", "}", "(", ")", "async ", "x", "é"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(3_000)]
    rows = spark.createDataFrame([(t,) for t in texts], "content string")
    sent = [r[0] for r in rows.where(worth_reading_js("content")).collect()]
    assert sorted(sent) == sorted(filter(may_hold_functions, texts)) and 0 < len(sent) < len(texts)
    assert any(JS_FUNCTION.search(t) for t in sent)
    assert not any(JS_FUNCTION.search(t) and "{" in t for t in texts if not may_hold_functions(t))


def test_every_match_holds_the_sign_of_its_rule(spark):
    """Texts of the rules' own literals: none that a pattern finds fails the test of its file."""
    rng = random.Random(9)
    rules = INSECURE_RULES + ERROR_RULES + SQL_RULES + N_PLUS_1_RULES + UNBOUNDED_RULES + EXPENSIVE_RULES
    bits = {
        part for r in rules for n in (*r.needles, r.sign) for part in (n, n.upper()) if part
    } | {"(x)", ")", " ", "=", "'", '"', "*", "{", "}", "\n", "for (x) {", "execute(f'", ".select(", "from(", "origin", "shell=True", "false", "KEY"}
    texts = ["".join(rng.choice(sorted(bits)) for _ in range(rng.randint(1, 12))) for _ in range(6_000)]
    texts += ["eval (", "innerHTML =", "cors origin *", "a.sort( )", "except :", "PASSWORD = 'x'", "sha1(", ".fetchall( )"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").cache()
    signed = [r for r in rules if r.sign]
    assert len(signed) > 15
    lost = " OR ".join(f"(t RLIKE {sql_text(r.java)} AND NOT {r.possible_in_file('t', 'lower(t)')})" for r in rules)
    hits = rows.select(*[F.expr(f"count_if(t RLIKE {sql_text(r.java)})") for r in signed]).first()
    assert rows.where(lost).collect() == [] and sum(n > 0 for n in hits) > 10
    loops = ["for x in y:\n  re.match(", "while a:\n\tdb.fetchone (", "for x in y\n re.match(", "for x: a.b(", "for x:\n .from_("]
    rows = spark.createDataFrame([(t,) for t in loops], "t string")
    for rule in LOOP_RULES:
        found_in = f"t RLIKE {sql_text(java_pattern(rule.call))} AND t RLIKE {sql_text(java_pattern(rule.header))}"
        assert rows.where(f"{found_in} AND NOT {rule.possible_in('t')}").collect() == [] and rows.where(found_in).count() > 0


HOSTILE = [
    "for (", "for (x) {", "){await .", "for (x) {await ", "while(", ".forEach(", ".map({supabase", "for(supabase", "supabase.from(", "supabase.from(x).select(",
    ".select('*')", ".select(*).limit", ".fetchall()", "for(JSON.parse", "JSON.parse(", "async function ", "=> { readFileSync", ".eq('", ".sort()", "for(+=", ".sort( ).reverse",
    "for x in y:", "while  ", "re.compile (", "for x",
]


def test_hostile_texts_end_soon(files):
    """500 kB of any rule's own literals, on one line and on many, with every rule on it."""
    rows = files(
        *[("p", f"{i}.js", b * (500_000 // len(b)) + "\nawait supabase JSON.parse += readFileSync") for i, b in enumerate(HOSTILE)],
        *[("p", f"{i}b.js", (b + "\n") * (100_000 // len(b)) + "await supabase JSON.parse += readFileSync") for i, b in enumerate(HOSTILE)],
    )
    rows = rows.repartition(4).cache()
    rows.count()
    start = time.time()
    op.multiline_scan(rows, PERFORMANCE_RULES).collect()
    assert time.time() - start < 2 * 2 * len(HOSTILE)


def test_loop_flags_agree_with_the_patterns_they_stand_for(spark):
    rng = random.Random(11)
    signs = ["for", "while", " ", " ", ":", "x", "\r", " ", "\t", " "]
    rows = [("".join(rng.choice(signs) for _ in range(rng.randint(0, 9))),) for _ in range(4_000)]
    header, ends = LOOP_RULES[0].header, rf"[{SPACE}]*\z"
    lines = spark.createDataFrame(rows, "line string")
    tail = lines.where(F.col("line").rlike(TAIL) != F.col("line").rlike(rf"[^{SPACE}].*:{ends}"))
    head = lines.where(F.col("line").rlike(java_pattern(LOOP_LINEAR)) != F.col("line").rlike(java_pattern(header) + ends))
    assert tail.collect() == [] and head.collect() == []


def test_loop_rules_read_a_long_line_once(files):
    loop = "for x in ids:\n    db.execute(x)\n"
    long = ["# " + "for x " * 30_000, "a" * 200_000, "a" * 100_000 + ":" * 100_000 + "b"]
    begun = time.perf_counter()
    got = op.loop_scan(files(*[("p", f"{i}.py", f"{loop}{line}\n") for i, line in enumerate(long)]))
    assert [line for _, line, _, _ in found(got)] == [1, 1, 1]
    assert time.perf_counter() - begun < 20
