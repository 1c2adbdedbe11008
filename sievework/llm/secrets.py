"""Secrets, with multipart credentials linked by an interval join.

Strict patterns give the base spans, which always stay. Beyond them there are weak
candidates: values that look random, or short passwords, which alone would be noise.
Access identifiers (user names, key ids) and endpoints (URLs, hosts with ports) are
complementary parts. A weak candidate is reported only when such a part lies within
``REACH`` code points of it in the same text and paragraph: that is its scope.

The parts of all texts are rows, placed in windows of ``REACH`` code points; a candidate
meets the parts of its own and the next windows in an equi-join and needs one of them, so
no pairs are listed. Only SQL functions touch the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import entropy
from ..plans.scale import stage
from .spans import digest, hits, in_order, listed, number_of, place, smaller, spans, touching

KINDS = ("assign", "access", "hex", "weak")
REACH = 200
MIN_ENTROPY = 3.5
VALUE = r"[A-Za-z0-9+/_.=-]"

ASSIGN = (
    r"(?i:password|passwd|secret|token|api_?key)[\"']?+\x20*+[:=]\x20*+[\"']?+[A-Za-z0-9+/_.=-]++"
)
ASSIGNED = r"\A(?i:password|passwd|secret|token|api_?key)[\"']?+\x20*+[:=]\x20*+[\"']?+"
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"[0-9a-f]{32,}+"

# Weak candidates and their complements.
RANDOM = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"
SHORT = r"(?i:password|passwd|pwd|pass|secret)[\"']?+\x20*+[:=]\x20*+[\"']?+[^\s\"',;]{4,64}+"
IDENTIFIER = (
    r"(?i)(?<![A-Za-z0-9])(?:user(?:name)?|login|client_?id|account|access_?key(?:_?id)?)[\"']?+\x20*+[:=]\x20*+"
    r"[\"']?+[^\s\"',;]{2,64}+"
)
KEY_ID = r"(?<![A-Z0-9])(?:AKIA|ASIA)[A-Z0-9]{12,}+"
ENDPOINT = (
    r"(?<![A-Za-z])[a-z][a-z0-9+.-]{1,20}+://[^\s\"'<>]++|"
    r"(?i:host|server|endpoint|url)[\"']?+\x20*+[:=]\x20*+[\"']?+[A-Za-z0-9.-]{4,}+(?::[0-9]{2,5}+)?"
)


def _base(text: str) -> Column:
    cue = f"lower({text}) RLIKE 'pass|secret|token|api'"
    assign = F.filter(
        hits(text, ASSIGN, cue), lambda h: F.length(F.regexp_replace(h["found"], ASSIGNED, "")) >= 8
    )
    access = F.filter(hits(text, ACCESS, f"contains({text}, 'AKIA')"), lambda h: F.length(h["found"]) >= 16)
    return F.concat(spans(assign, "assign"), spans(access, "access"), spans(hits(text, HEX), "hex"))


def _mixed(value: Column) -> Column:
    """Letters of both cases and digits, or much entropy: not a word or a number."""
    both = value.rlike("[A-Z]") & value.rlike("[a-z]") & value.rlike("[0-9]")
    return both & (entropy(value) >= MIN_ENTROPY)


def _parts(text: str) -> Column:
    """Weak candidates and complementary parts: array<struct<start,end,kind>>."""
    weak = F.filter(hits(text, RANDOM, f"{text} RLIKE '[0-9]'"), lambda h: _mixed(h["found"]))
    short = hits(text, SHORT, f"lower({text}) RLIKE 'pass|pwd|secret'")
    names = hits(text, IDENTIFIER, f"lower({text}) RLIKE 'user|login|client|account|access'")
    keys = hits(text, KEY_ID, f"{text} RLIKE 'AKIA|ASIA'")
    ends = hits(text, ENDPOINT, f"contains({text}, '://') OR lower({text}) RLIKE 'host|server|endpoint|url'")
    return F.concat(
        spans(weak, "weak"), spans(short, "weak"), spans(names, "part"), spans(keys, "part"), spans(ends, "part")
    )


def read_parts(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, base, weak, parts) of whole texts.

    Weak candidates and parts are structs of start, end and scope, the number of blank
    lines before, where paragraphs end. They are only kept for texts that have both.
    """
    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "text",
        in_order(_base("text"), KINDS).alias("base"),
        _parts("text").alias("found"),
    )
    touched = F.zip_with(
        "found", touching(F.col("found"), F.col("base")), lambda f, n: F.when((f["kind"] == "part") | (n == 0), f)
    )
    rows = rows.withColumn("found", F.filter(touched, lambda f: f.isNotNull()))
    both = F.exists("found", lambda f: f["kind"] == "part") & F.exists("found", lambda f: f["kind"] == "weak")
    rows = rows.withColumn("found", F.when(both, F.col("found")).otherwise(F.filter("found", lambda f: F.lit(False))))
    scopes = smaller(
        F.transform(hits("text", r"\n[\x20\t\r]*+\n", "size(found) > 0"), lambda h: place(0, h["start"])),
        F.transform("found", lambda f: place(0, f["start"])),
    )
    rows = rows.withColumn("found", F.zip_with("found", scopes, lambda f, n: f.withField("scope", n)))
    return rows.select(
        "row",
        "doc_id",
        "base",
        F.filter("found", lambda f: f["kind"] == "weak").alias("weak"),
        F.filter("found", lambda f: f["kind"] == "part").alias("parts"),
    )


def link(read: DataFrame, reach: int = REACH) -> DataFrame:
    """(row, start, end) of the weak candidates that a complementary part supports."""

    def placed(column: str) -> DataFrame:
        rows = read.select("row", F.inline(column))
        return rows.select("row", "start", "end", "scope", F.floor(F.col("start") / reach).alias("window"))

    weak = placed("weak").alias("w")
    # A part also shows in the windows before and after its own, as a gap may cross one.
    near = F.explode(F.sequence(F.col("window") - 1, F.floor(F.col("end") / reach) + 1)).alias("window")
    parts = placed("parts").select("row", "start", "end", "scope", near).alias("p")
    gap = F.greatest(F.col("p.start") - F.col("w.end"), F.col("w.start") - F.col("p.end"), F.lit(0))
    apart = (F.col("p.start") >= F.col("w.end")) | (F.col("w.start") >= F.col("p.end"))
    met = (
        (F.col("w.row") == F.col("p.row"))
        & (F.col("w.window") == F.col("p.window"))
        & (F.col("w.scope") == F.col("p.scope"))
        & apart
        & (gap <= reach)
    )
    return weak.join(parts, met, "left_semi").select("row", "start", "end")


def find_secrets(docs: DataFrame, reach: int = REACH, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, ``base`` and ``spans``, arrays of (start, k, end, kind).

    Places are code points, end exclusive, in order of start and kind; linked candidates
    have the kind ``weak``. A null text is empty and has no spans; repeated rows and ids
    give a row each; other columns are ignored.
    """
    read = stage(read_parts(docs, id, text), "secrets")
    one = F.struct("start", "end", F.lit("weak").alias("kind"))
    linked = link(read, reach).groupBy("row").agg(F.collect_set(one).alias("linked"))
    rows = read.select("row", "doc_id", "base").join(linked.withColumnRenamed("row", "of"), F.col("row") == F.col("of"), "left")
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    added = F.coalesce("linked", F.expr("filter(transform(base, b -> struct(b.start, b.end, b.kind)), b -> false)"))
    return rows.select("doc_id", "base", in_order(F.concat(base, added), KINDS).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    counts = [number_of("base", k).alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, digest(F.col("base")).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
