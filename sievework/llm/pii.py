"""Personal data: broad generators, boosted trees, calibrated thresholds.

Strict patterns with checks (address parts, check digits, digit counts) give the base
spans, which always stay. Generators with high recall propose more spans, which may
overlap: loosely written addresses, digit groups as card or phone numbers, dotted
numbers. Boosted trees judge a proposal by its format and its context. Their labels are
the strict patterns' own verdicts, but the checks are no features, so what is learned of
form and surroundings carries over to spans that the checks refuse: a mistyped card
number among card numbers, an address with "at". Half of the documents fit the trees,
the other half sets for each kind the lowest margin with the wanted precision; without
one, nothing of that kind is added. Of overlapping proposals the one with the larger
margin stays, and none that touches a base span.

Everything that touches the rows is a SQL function. The text is read once; spans and
features are staged. Training reads the counts of feature cells, a table whose size the
grid bounds, over all documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scale import stage
from ..schema import sql_text
from .boosting import Boosted, Cell, fit, threshold
from .spans import digest, digits, hits, in_order, listed, luhn, number_of, place, smaller, spans, touching

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.9

# Strict patterns. Each is the stated one with guards and possessive loops, which leave
# the matches as they are and keep the search linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# Generators: (name, kinds proposed, pattern, cheap test).
ADDRESS_LIKE = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++"
    r"(?:\x20?(?:\.|\(dot\)|\[dot\])[A-Za-z0-9-]++)++"
)
DIGITS_LIKE = r"(?<![0-9A-Za-z.])\+?[(]?[0-9](?:[\x20().-]{0,2}[0-9]){8,}+(?![A-Za-z])"
DOTTED_LIKE = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])"
GENERATORS = (
    ("address", ("email",), ADDRESS_LIKE, "text RLIKE '@|[(\\\\[]at[)\\\\]]'"),
    ("digits", ("card", "phone"), DIGITS_LIKE, "true"),
    ("dotted", ("ip",), DOTTED_LIKE, "true"),
)
FEATURES = ("kind", "length", "groups", "joint", "plus", "before", "after", "cue")
CUES = {
    "email": r"(?i)(?:mail|contact|write|address)[^\n]{0,12}\z",
    "ip": r"(?i)(?:\bip\b|host|server|address|addr)[^\n]{0,12}\z",
    "card": r"(?i)(?:card|visa|credit|debit|account|payment)[^\n]{0,12}\z",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|cell)[^\n]{0,12}\z",
}
CONTEXT = 24


def _base(text: str) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    small = lambda p: (F.length(part(p)) <= 3) & (F.try_to_number(part(p), F.lit("999")) <= 255)
    ip = F.filter(hits(text, IP), lambda h: F.forall(F.split(h["found"], "\\."), small))
    card = F.filter(hits(text, CARD), lambda h: (F.length(digits(h["found"])) <= 19) & luhn(digits(h["found"])))
    phone = F.filter(
        hits(text, PHONE, f"contains({text}, '+')"), lambda h: F.length(digits(h["found"])).between(10, 15)
    )
    email = hits(text, EMAIL, f"contains({text}, '@')")
    return F.concat(spans(email, "email"), spans(ip, "ip"), spans(card, "card"), spans(phone, "phone"))


def _class_of(char: Column) -> Column:
    """0 edge, 1 space, 2 letter or digit, 3 bracket or quote, 4 other."""
    return (
        F.when(char == "", 0)
        .when(char.rlike(r"\s"), 1)
        .when(char.rlike(r"[\p{L}\p{N}]"), 2)
        .when(char.rlike("[\"'()<>\\[\\]{}]"), 3)
        .otherwise(4)
    )


def _proposals(text: str) -> Column:
    """All proposals with their features; one hit may be proposed as several kinds."""
    parts = []
    for _, kinds, pattern, possible in GENERATORS:
        found = hits(text, pattern, possible.replace("text", text), CONTEXT)
        for kind in kinds:
            parts.append(F.transform(found, _proposed(kind)))
    return F.concat(*parts)


def _proposed(kind: str) -> Callable[[Column], Column]:
    return lambda h: _features(h, kind)


def _features(h: Column, kind: str) -> Column:
    found = h["found"]
    n = F.length(digits(found))
    joints = F.regexp_replace(found, r"[\p{L}\p{N}_%+]", "")
    return F.struct(
        h["start"].alias("start"),
        h["end"].alias("end"),
        F.lit(kind).alias("kind_name"),
        F.lit(KINDS.index(kind)).alias("kind"),
        F.least(F.when(F.lit(kind == "email"), F.length(found) / 8).otherwise(n).cast("int"), F.lit(20)).alias("length"),
        F.least(F.length(joints), F.lit(5)).alias("groups"),
        F.when(joints == "", 0)
        .when(joints.rlike(r"\A\x20+\z"), 1)
        .when(joints.rlike(r"\A-+\z"), 2)
        .when(joints.rlike(r"\A[.@]+\z"), 3)
        .when(joints.rlike(r"[()]"), 4)
        .otherwise(5)
        .alias("joint"),
        F.startswith(found, F.lit("+")).cast("int").alias("plus"),
        _class_of(F.right(h["before"], F.lit(1))).alias("before"),
        _class_of(h["after"]).alias("after"),
        h["before"].rlike(CUES[kind]).cast("int").alias("cue"),
    )


def read_spans(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, proposals, fold) of whole texts; ``known`` in a proposal is its label."""
    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    fold = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(2)).cast("int")
    rows = rows.select(
        "doc_id", in_order(_base("text"), KINDS).alias("base"), _proposals("text").alias("proposals"), fold.alias("fold")
    )
    met = touching(F.col("proposals"), F.col("base"), lambda p: p["kind"] + 1, lambda b: b["k"])
    labelled = F.zip_with("proposals", met, lambda p, n: p.withField("known", (n > 0).cast("int")))
    return rows.select("doc_id", "base", labelled.alias("proposals"), "fold")


def train(read: DataFrame, precision: float = PRECISION) -> tuple[Boosted, dict[str, float | None]]:
    """The trees, and each kind's margin, from the counts of all proposals."""
    rows = read.select("fold", F.inline("proposals"))
    counts = rows.groupBy("fold", *FEATURES).agg(
        F.sum("known").alias("positive"), F.count(F.lit(1)).alias("n")
    )
    cells = {0: [], 1: []}
    for r in counts.collect():
        values = tuple(int(r[f]) for f in FEATURES)
        cells[r.fold].append(Cell(values, float(r.positive), float(r.n - r.positive)))
    model = fit(cells[0])
    limits = {
        kind: threshold(model, [c for c in cells[1] if c.values[0] == i], precision) for i, kind in enumerate(KINDS)
    }
    return model, limits


def select_spans(read: DataFrame, model: Boosted, limits: dict[str, float | None]) -> DataFrame:
    """Adds ``spans``: the base spans and the proposals that pass, without overlaps among the added."""
    short = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    base = F.transform("base", short)
    if all(limit is None for limit in limits.values()):
        return read.select("doc_id", "base", in_order(base, KINDS).alias("spans"))
    margin = model.sql([f"p.{f}" for f in FEATURES])
    scored = F.expr(
        "transform(proposals, p -> named_struct('k', p.kind, 'start', p.start, 'end', p.end, "
        f"'kind', p.kind_name, 'margin', {margin}))"
    )
    passes = " OR ".join(
        f"(q.kind = {sql_text(k)} AND q.margin >= {m!r}D)" for k, m in limits.items() if m is not None
    )
    rows = read.withColumn("passed", F.filter(scored, lambda q: _passes(q, limits)))
    free = F.zip_with("passed", touching(F.col("passed"), F.col("base")), lambda q, n: F.when(n == 0, q))
    rows = rows.withColumn("chosen", F.sort_array(F.filter(free, lambda q: q.isNotNull())))
    kept = F.filter(_unbeaten(), lambda q: q.isNotNull())
    return rows.select("doc_id", "base", in_order(F.concat(base, F.transform(kept, short)), KINDS).alias("spans"))


def _passes(q: Column, limits: dict[str, float | None]) -> Column:
    passes = F.lit(False)
    for kind, limit in limits.items():
        if limit is not None:
            passes = passes | ((q["kind"] == kind) & (q["margin"] >= limit))
    return passes


def _unbeaten() -> Column:
    """The array ``chosen``, with null for those that overlap a better one.

    The chosen of one kind are disjoint, so those that meet a span are a range of the
    sorted array, and all ranges together are not longer than the array times the kinds.
    """
    chosen = F.col("chosen")
    left = F.transform(chosen, lambda q: q)
    for k in range(len(KINDS)):
        lo = smaller(
            F.transform(chosen, lambda r: place(r["k"], r["end"])),
            F.transform(chosen, _placed_as(k, lambda q: q["start"] + 1)),
        )
        hi = smaller(
            F.transform(chosen, lambda r: place(r["k"], r["start"])),
            F.transform(chosen, _placed_as(k, lambda q: q["end"])),
        )
        meets = F.zip_with(lo, hi, lambda a, b: F.slice(chosen, (a + 1).cast("int"), (b - a).cast("int")))
        left = F.zip_with(left, meets, lambda q, rs: F.when(~F.exists(rs, _better_than(q)), q))
    return left


def _placed_as(k: int, at: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda q: place(k, at(q))


def _better_than(q: Column) -> Callable[[Column], Column]:
    order = lambda s: F.struct(s["start"], s["end"], s["kind"])
    return lambda r: (r["margin"] > q["margin"]) | ((r["margin"] == q["margin"]) & (order(r) < order(q)))


def find_personal_data(
    docs: DataFrame, precision: float = PRECISION, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: doc_id, ``base`` and ``spans``, arrays of (start, k, end, kind).

    Places are code points, end exclusive, in order of start and kind. A null text is
    empty and has no spans; repeated rows and ids give a row each; other columns are
    ignored. An empty table trains nothing and gives no rows.
    """
    read = stage(read_spans(docs, id, text), "personal")
    return select_spans(read, *train(read, precision))


def digests(found: DataFrame) -> DataFrame:
    counts = [number_of("base", k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, digest(F.col("base")).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
