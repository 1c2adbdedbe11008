"""Line rules: prefixes, gated secrets, first match, comments, downgrading."""

from pyspark.sql import functions as F

from sievework import operators as op
from sievework.operators.lines import error_group, insecure_group, line_scan, prefix_group, secret_group, sql_group
from sievework.rules import ERROR_RULES, INSECURE_RULES, SECRET_RULES, SQL_RULES, Rule, needle_parts, valid_rules

KEY = "abcdefghij0123456789KLMN"


def found(df):
    return sorted((r.file, r.line, r.severity, r.message) for r in df.collect())


def test_lines_keep_trailing_empty_ones(files):
    rows = op.lines(files(("p", "a", "x\n\n"), ("p", "b", "y"))).collect()
    assert sorted((r.path, r.line, r.text) for r in rows) == [("a", 1, "x"), ("a", 2, ""), ("a", 3, ""), ("b", 1, "y")]


def test_prefix_reports_every_prefix_of_a_line(files):
    text = f"# 'ghp_{KEY}'\nx = 'sk-ant-{KEY}'\ny = 'ghp_123456789'\n * 'ghp_{KEY}'\nz = \"AKIA{KEY}\""
    got = op.prefix_scan(files(("p", "a.py", text), ("p", "tests/a.py", f"k='ghp_{KEY}'"))).collect()
    assert sorted((r.file, r.line, r.severity) for r in got) == [
        ("p/a.py", 2, "critical"), ("p/a.py", 2, "critical"), ("p/a.py", 5, "critical"), ("p/tests/a.py", 1, "info"),
    ]
    assert any(r.message.endswith("(test file)") for r in got)
    assert all(KEY not in r.snippet for r in got)


def test_secret_gate_is_at_entropy_three_and_length_ten(files):
    rows = [
        "password = 'abcdefgh'",      # entropy 3.0 but eight characters
        "password = 'abcdefghij'",    # passes
        "password = 'aaaaaaaaaaaa'",  # long but flat
        "password = 'aabbccddeeffgghh'",  # entropy exactly 3.0
        "x = sk-" + "a" * 20,         # no quoted value: no gate
        "api_key: \"" + KEY + "\"",
        "secret = 'nothing'",
    ]
    got = op.secret_scan(files(("p", "a.py", "\n".join(rows))))
    assert [r.line for r in sorted(got.collect(), key=lambda r: r.line)] == [2, 4, 5, 6]
    assert {r.severity for r in got.collect()} == {"warning"}


def test_failed_gate_moves_on_to_the_next_rule(files):
    rules = [Rule(r"k\s*=\s*'[^']*'", "first", "warning"), Rule(r"k\s*=", "second", "warning")]
    got = op.secret_scan(files(("p", "a.py", "k = 'aaa'\nk = 'abcdefghijkl'")), rules)
    assert found(got) == [("p/a.py", 1, "warning", "second"), ("p/a.py", 2, "warning", "first")]


def test_first_match_stops_at_one_rule_per_line(files):
    text = "eval(os.system(x))\n// eval(x)\n* eval(x)\npassword = 'p'\nverify = False"
    got = line_scan(files(("p", "a.py", text)), [insecure_group()])
    assert [(line, severity) for _, line, severity, _ in found(got)] == [
        (1, "warning"), (3, "warning"), (4, "critical"), (5, "critical"),
    ]


def test_insecure_snippet_is_redacted_and_cut(files):
    got = line_scan(files(("p", "a.py", "password = 'supersecretvalue'" + " " * 300 + "x")), [insecure_group()])
    row = got.first()
    assert "supersecretvalue" not in row.snippet and len(row.snippet) <= 200


def test_groups_report_independently(files):
    text = 'try: db.execute(f"{x}")\nexcept: db.execute(f"select {x}")\nawait fetch(u).catch(e)\nfetch(u)'
    got = line_scan(files(("p", "a.py", text)), [error_group(), sql_group()])
    assert [(line, severity) for _, line, severity, _ in found(got)] == [
        (1, "critical"), (2, "critical"), (2, "warning"), (4, "info"),
    ]


def test_every_insecure_rule_has_a_hit_its_gate_lets_through(files):
    hits = [
        "eval (x)", "child_process.exec(x)", "subprocess.call(a, shell = True)", "os.system(x)", "a.innerHTML = x",
        "dangerouslySetInnerHTML", "CORS({Origin: '*'})", "DISABLE_SSL", "SHA1 (x)", "Math.random()",
        "PASSWORD = 'x'", "-----begin rsa private key",
    ]
    got = line_scan(files(*[("p", f"{i}.py", h) for i, h in enumerate(hits)]), [insecure_group()])
    by_file = {r.file: r.message for r in got.collect()}
    assert [by_file[f"p/{i}.py"] for i in range(len(hits))] == [r.message for r in INSECURE_RULES]


def test_every_secret_rule_has_a_hit_its_gate_lets_through(files):
    hits = [
        "auth-token: 'abcdefghijkl'", f"GITHUB x = '{KEY}'", f"sk-{KEY[:20]}", "ghp_" + "a1B2" * 9,
        f"eyJ{KEY}.{KEY}", f"xoxb-1234567890-{KEY}", "-----BEGIN EC PRIVATE KEY-----",
    ]
    for i, hit in enumerate(hits):
        got = op.secret_scan(files(("p", "a.py", hit)), [SECRET_RULES[i]])
        assert got.count() == 1, hit


def test_rules_that_do_not_compile_are_left_out(spark):
    good, bad = Rule("a+", "m", "info"), Rule("(a", "m", "info")
    assert valid_rules(spark, [good, bad, good]) == [good, good]


def test_downgrade(files):
    got = op.downgrade(line_scan(files(("p", "mock/a.py", "eval(x)"), ("p", "b.py", "eval(x)")), [insecure_group()]))
    assert {r.file: r.severity for r in got.collect()} == {"p/mock/a.py": "info", "p/b.py": "warning"}


def test_line_scan_does_not_shuffle(files):
    plan = line_scan(files(("p", "a.py", "x")), [insecure_group()])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


LINE_RULES = [*SECRET_RULES, *INSECURE_RULES, *ERROR_RULES, *SQL_RULES]


def test_linear_forms_agree_with_the_plain_patterns(spark):
    import random

    rng = random.Random(1)
    bits = [
        "cors", "origin", "*", "disable", "ssl", "verify", " = ", "False", "rejectUnauthorized", "false", "execute(", "query (", "f'", '"', "run(f'", "execute( '",
        "%s", "%", "{", "}", "+ ", "req.", "body.", "aws", "github", "=", "'abcdefghij0123456789_x'", "subprocess.call(", "shell=True", " ", "x", "'",
        "fetch(", "fetch (", "await ", ")", ").then(", ".catch", " .catch(", "eyJ", "abcdefghij0123456789", ".", "-", "_",
    ]
    lines = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(9000)]
    lines += ["run('%s' % x", "query(f'{a}')", "execute('a' + req.x)", "subprocess.call(x shell = True", "github = 'abcdefghij0123456789_x'"]
    lines += ["fetch(u)", "fetch(u).then(x).catch(y)", "fetch(fetch(u).catch", "fetch()", "eyJeyJabcdefghij0123456789.abcdefghij0123456789-", "x-eyJabc"]
    df = spark.createDataFrame([(t,) for t in lines], "t string").repartition(4).cache()
    for rule in [r for r in LINE_RULES if r.linear or r.shown]:
        plain = df.select("t", F.col("t").rlike(rule.java).alias("p"), F.expr(rule.found_in("t")).alias("q")).collect()
        assert [r.t for r in plain if r.p != r.q] == [], rule.pattern
        assert any(r.p for r in plain), rule.pattern
        if rule.shown:
            both = df.where(F.col("t").rlike(rule.java)).selectExpr(f"{rule.match_in('t')} AS a", f"{Rule(rule.pattern, '', '').match_in('t')} AS b")
            assert both.where("a <> b").count() == 0, rule.pattern


# What each rule's heads and gaps are made of: without their tails, a plain search tries
# the rest of the line behind each of them.
LITERALS = [
    "cors origin ", "aws=x; ", "disable ", "rejectUnauthorized ", "verify = ", "execute(f'", "execute('%s", "run('", "subprocess.call(", "fetch(", "fetch(x, ",
    "await fetch (", "eyJ", "eyJ0123456789", "sk-", "ghp_", "xoxb-1234567890-", "-----BEGIN ", "BEGIN PRIVATE ", "password = ", "password='", "api_key: ",
    "github.", "slack= '", "eval ", "child_process.exec ", "os.system ", "innerHTML ", "md5 ", "Math.random ", "except ", "'sk-ant-", '"eyJhbG', "query ( '", "+ req",
]


def test_hostile_lines_end_soon(files):
    """A line of 500 kB of any rule's own literals, with every rule on it."""
    import time

    rows = files(*[("p", f"{i}.py", b * (500_000 // len(b)) + ' "q" ') for i, b in enumerate(LITERALS)])
    rows = rows.repartition(4).cache()
    rows.count()
    groups = [prefix_group(), secret_group(), insecure_group(), error_group(), sql_group()]
    start = time.time()
    line_scan(rows, groups).collect()
    assert time.time() - start < 2 * len(LITERALS)


def test_a_bad_rule_is_left_out_and_reported(files, spark):
    from sievework.operators.lines import rule_errors

    rules = [Rule("(unclosed", "bad", "warning"), Rule("ok", "fine", "warning", gate="[z-a]"), Rule("eval", "good", "warning")]
    rows = files(("p", "a.py", "eval ok"))
    assert found(op.first_match_scan(rows, rules)) == [("p/a.py", 1, "warning", "good")]
    assert [r.message for r in op.multiline_scan(rows, rules).collect()] == ["good"]
    assert op.secret_scan(rows, rules).count() == 1
    assert len(rule_errors(spark, rules).collect()) == 2


def test_needles_are_looked_for_from_their_rarest_sign():
    assert [needle_parts(n)[0] for n in ("token", "request.", "key", "fetch", "sk-", "-")] == ["ken", "quest.", "key", "fetch", "k-", "-"]
    for rule in (*SECRET_RULES, *INSECURE_RULES, *ERROR_RULES, *SQL_RULES):
        for needle in rule.needles:
            assert needle_parts(needle)[-1] == needle and needle.endswith(needle_parts(needle)[0])
