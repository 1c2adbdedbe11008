"""Scalar functions: each row is a case worked out by hand."""

import pytest
from pyspark.sql import functions as F

from sievework import functions as fn
from sievework.rules import java_pattern


def values(spark, texts, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in rows.select("i", column.alias("v")).orderBy("i").collect()]


def test_strip_takes_any_white_space(spark):
    assert values(spark, ["\t x \u00a0", "", " \x1c", "a b"], fn.strip("t")) == ["x", "", "", "a b"]


def test_newlines(spark):
    assert values(spark, ["a\r\nb\rc\nd", "\r\r\n"], fn.normalise_newlines("t")) == ["a\nb\nc\nd", "\n\n"]


def test_entropy(spark):
    got = values(spark, ["", "aaaa", "aabb", "abcdefgh", None], fn.entropy("t"))
    assert got[:4] == [0.0, 0.0, 1.0, 3.0] and got[4] is None


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ('k = "12345678"', 'k = "12345678"'),
        ('k = "123456789"', 'k = "12345678...REDACTED"'),
        ("'ab' + some long name + 'cd'", "'ab' + some long name + 'cd'"),
        ("it's \"123456789\" open", "it's \"12345678...REDACTED\" open"),
        ("''x\"abcdefghij\"", "''x\"abcdefgh...REDACTED\""),
        ("plain", "plain"),
    ],
)
def test_redact_keeps_quotes_in_step(spark, text, expected):
    assert values(spark, [text], fn.redact("t")) == [expected]


def test_snippet_redacts_before_it_cuts(spark):
    text = " " + "x" * 195 + '"secretsecretsecret"'
    got = values(spark, [text], fn.snippet("t"))[0]
    assert len(got) == 200 and got == "x" * 195 + '"secr'


def test_versions(spark):
    texts = ["^1.2.3", "~>=0.4", "1", "v1.2", "", ">= 2.10.0-rc1"]
    assert values(spark, texts, fn.parse_version("t")) == [[1, 2, 3], [0, 4], [1], None, None, [2, 10, 0]]
    wide = [["20240101123456", 0, 1], [(1 << 63) - 1, 2]]
    assert values(spark, ["20240101123456.0.1", "9" * 30 + ".2"], fn.parse_version("t")) == [[int(x) for x in w] for w in wide]
    assert values(spark, ["^~1.0", "1.^"], fn.clean_version("t")) == ["1.0", "1.^"]


def test_comment_markers(spark):
    texts = ["  # x", "\t// y", "* z", "x # y", ""]
    assert values(spark, texts, fn.is_comment("t")) == [True, True, False, False, False]
    assert values(spark, texts, fn.is_comment("t", ("#", "//", "*")))[2] is True


def test_file_lang_and_downgrade(spark):
    assert values(spark, ["a.py", "b.mjs", "c.tsx", "d.jsx", "e.PY"], fn.file_lang("t")) == [
        "python", "javascript", "javascript", "unknown", "unknown",
    ]
    assert values(spark, ["p/latest.py", "p/a.spec.ts", "p/special.ts"], fn.downgraded("t")) == [True, True, False]


def test_fingerprint_ignores_names_comments_and_strings(spark):
    a = 'x = 1 // note\ny = "a b c"  +  foo'
    b = "yy = 1 /* other\n note */ z = `\\`` + bar"
    c = 'x = 2 // note\ny = "a b c" + foo'
    got = values(spark, [a, b, c], fn.text_fingerprint("t"))
    assert got[0] == got[1] != got[2]


def test_fingerprint_of_long_strings_does_not_overflow(spark):
    text = "x = '" + "\\a" * 60_000 + "'"
    assert values(spark, [text, "y = 'b'"], fn.text_fingerprint("t"))[0] is not None


def test_age_is_a_fraction(spark):
    rows = spark.sql("SELECT timestamp'2024-01-01' AS m, timestamp'2024-01-02 12:00:00' AS a")
    assert rows.select(fn.age_days("m", "a").alias("d")).first().d == 1.5


def test_java_patterns_cover_unicode(spark):
    column = F.col("t").rlike(java_pattern(r"^\w+\s[\w.]+$"))
    assert values(spark, ["é ü.1", "a-b c", "a\u00a0b"], column) == [True, False, True]
    assert values(spark, ["PÄSS"], F.col("t").rlike(java_pattern("(?i)päss"))) == [True]
