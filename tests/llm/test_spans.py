"""Personal data, secrets, the registered queries and the pipeline."""

import random
import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import corpus_pipeline
from sievework.llm import boosting, mixing, pii, quality, secrets, spans
from sievework.llm import queries as llm_queries
from sievework.llm.oracle import ORACLE
from sievework.plans.scale import stage

from .test_filters import brute_components, edit_search, prose, table, words
from .test_texts import plain_ids

SMALL = "/root/testdata/sf0.001"
LENIENT = dict(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_personal(x):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return [(a, b, k) for a, _, b, k in sorted(out)]


def base_secrets(x):
    out = []
    keys = r"(?:[pP][aA][sS][sS][wW](?:[oO][rR])?[dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    for m in re.finditer(keys + r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", x):
        if len(m[1]) >= 8:
            out.append((m.start(), 0, m.end(), "assign"))
    for m in re.finditer("AKIA[A-Z0-9]+", x):
        if len(m[0]) >= 16:
            out.append((m.start(), 1, m.end(), "access"))
    for m in re.finditer("[0-9a-f]+", x):
        if len(m[0]) >= 32:
            out.append((m.start(), 2, m.end(), "hex"))
    return [(a, b, k) for a, _, b, k in sorted(out)]


def seen(rows):
    return {r.doc_id: [(s.start, s.end, s.kind) for s in r.base] for r in rows}


PERSONAL_BITS = st.sampled_from(
    ["a.b@c.de", "x@y", "@", ".", "1.2.3.4", "256.1.1.1", "0001.2.3.4.5.6.7.8", "4539578763621486", "4539-5787 6362 1486",
     "+1 (555) 123-4567", "+", "é", " ", "-", "12", "(", "\n", "mail", "_z@q.org.x_y@w.io"]
)
SECRET_BITS = st.sampled_from(
    ["token", "= ", ": ", '"', "Api_Key", "apikey", "PASSWD", "12345678", "AKIA", "ABCDEFGH12345678", "é", " ", "\n",
     "0123456789abcdef" * 2, "deadbeef", "secret", "'"]
)


@settings(**LENIENT)
@given(st.lists(st.lists(PERSONAL_BITS, max_size=12).map("".join), min_size=30, max_size=40))
def test_base_personal_data_as_stated(spark, texts):
    got = seen(pii.read_spans(table(spark, list(enumerate(texts)))).collect())
    assert got == {i: base_personal(t) for i, t in enumerate(texts)}


@settings(**LENIENT)
@given(st.lists(st.lists(SECRET_BITS, max_size=12).map("".join), min_size=30, max_size=40))
def test_base_secrets_as_stated(spark, texts):
    got = seen(secrets.read_parts(table(spark, list(enumerate(texts)))).collect())
    assert got == {i: base_secrets(t) for i, t in enumerate(texts)}


def test_long_and_missing_texts(spark):
    long = "g" * 200_000 + " 1" * 50_000 + " x@y.zz " * 3_000 + "(" * 50_000
    rows = [(1, None), (2, ""), (3, long), (3, long), (None, "x@y.zz")]
    got = pii.find_personal_data(table(spark, rows)).collect()
    assert Counter((r.doc_id, len(r.base)) for r in got) == {(1, 0): 1, (2, 0): 1, (3, 3000): 2, (None, 1): 1}
    assert {(r.doc_id, len(r.base)) for r in secrets.find_secrets(table(spark, rows)).collect()} == {(1, 0), (2, 0), (3, 0), (None, 0)}
    assert pii.find_personal_data(table(spark, [])).collect() == []
    assert secrets.find_secrets(table(spark, [])).collect() == []


NUMBERS = st.tuples(st.integers(0, 3), st.integers(0, 40))


@settings(**LENIENT)
@given(st.lists(st.tuples(st.lists(NUMBERS, max_size=9), st.lists(NUMBERS, max_size=9)), min_size=8, max_size=12))
def test_ranks_and_overlaps_as_stated(spark, rows):
    span = "array<struct<k:int,start:bigint,end:bigint>>"
    wide = [([(k, a, a + 1 + 3 * k) for k, a in ones], [(k, a, a + 1 + a % 7) for k, a in others]) for ones, others in rows]
    data = spark.createDataFrame([(i, *w) for i, w in enumerate(wide)], f"i int, ones {span}, others {span}")
    col = pii.F.col
    found = data.select(
        "i",
        spans.touching(col("ones"), col("others")).alias("any"),
        spans.touching(col("ones"), col("others"), lambda s: s["k"], lambda s: s["k"]).alias("own"),
    )
    for r in found.collect():
        ones, others = wide[r.i]
        meet = [[o for o in others if o[1] < e and s < o[2]] for _, s, e in ones]
        assert r["any"] == [len(m) for m in meet]
        assert r.own == [sum(o[0] == one[0] for o in m) for one, m in zip(ones, meet)]


def test_the_best_of_overlapping_proposals(spark):
    """Against comparing all pairs; the proposals of one kind are disjoint, as matches are."""
    rng = random.Random(8)
    better = lambda r, q: r[4] > q[4] or (r[4] == q[4] and r[1:4] < q[1:4])
    rows, want = [], {}
    for i in range(60):
        chosen = []
        for _ in range(rng.randrange(25)):
            k, start, size = rng.randrange(4), rng.randrange(60), rng.randrange(1, 25)
            if all(k != c[0] or c[2] <= start or start + size <= c[1] for c in chosen):
                chosen.append((k, start, start + size, pii.KINDS[k], float(rng.randrange(3))))
        chosen.sort()
        rows.append((i, chosen))
        want[i] = [q for q in chosen if not any(r[1] < q[2] and q[1] < r[2] and better(r, q) for r in chosen)]
    data = spark.createDataFrame(
        rows, "i int, chosen array<struct<k:int,start:bigint,end:bigint,kind:string,margin:double>>"
    )
    kept = data.select("i", pii.F.filter(pii._unbeaten(), lambda q: q.isNotNull()).alias("kept"))
    assert {r.i: [tuple(q) for q in r.kept] for r in kept.collect()} == want


def test_context_across_blocks(spark):
    rng = random.Random(4)
    text = "".join(rng.choice(["12.5.1.9", "7.7.7.7", " ", " é", " x ", "\n", " mail to ", "y" * 40]) for _ in range(5000))
    row = table(spark, [(1, text)]).select(spans.hits("text", pii.DOTTED_LIKE, "true", 24).alias("h")).first()
    want = [
        (m.start(), m.end(), m[0], text[max(m.start() - 24, 0) : m.start()], text[m.end() : m.end() + 1])
        for m in re.finditer(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])", text)
    ]
    assert len(want) > 2 * spans.BLOCK and [tuple(h) for h in row.h] == want


def test_very_many_matches_in_one_text(spark):
    """Were the work quadratic, each of these texts would take minutes."""
    many = 40_000
    personal = table(spark, [(1, "x@y.zz " * many), (2, "1.2.3.4 " * many), (3, "+1 555 123 4567\n" * (many // 2))])
    found = pii.find_personal_data(personal).collect()
    assert {r.doc_id: (len(r.base), len(r.spans)) for r in found} == {1: (many,) * 2, 2: (many,) * 2, 3: (many // 2,) * 2}
    value = "aB3dE6gH9jK2mN5pQ8sT"
    scopes = table(spark, [(1, f"user = admin {value}\n\n" * 10_000 + f"{value}\n\n" * 10_000)])
    found = secrets.find_secrets(scopes).collect()
    assert [len(r.spans) for r in found] == [10_000]


def test_proposals_like_the_rest_are_added(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        card = "45395787" + "".join(rng.choice("0123456789") for _ in range(7))
        check = next(c for c in "0123456789" if luhn(card + c))
        wrong = i % 40 == 0
        number = card + (str((int(check) + 1) % 10) if wrong else check)
        rows.append((i, f"{prose(rng, 8)} card {number} {prose(rng, 5)}" if i % 2 == 0 else f"{prose(rng, 9)} 12345 {prose(rng, 3)}"))
    got = {r.doc_id: r for r in pii.find_personal_data(table(spark, rows)).collect()}
    assert len(got[40].base) == 0 and [s.kind for s in got[40].spans] == ["card"]
    assert all(len(got[i].spans) == 0 for i in range(1, 400, 2))
    text = dict(rows)[40]
    s = got[40].spans[0]
    shown = table(spark, [(40, text)]).select(
        spans.masked(pii.F.col("text"), pii.F.expr(f"array(named_struct('start', {s.start}L, 'k', 3, 'end', {s.end}L, 'kind', 'card'))"))
    ).first()[0]
    assert shown == text[: s.start] + "[card]" + text[s.end :]


def test_trees_follow_the_counts():
    cells = [boosting.Cell((a, b), 90.0 * a * b + 1, 10.0 + 90.0 * (1 - a * b)) for a in (0, 1) for b in (0, 1)]
    model = boosting.fit(cells, depth=2)
    assert model.margin((1, 1)) > 1 > -1 > model.margin((0, 1))
    assert boosting.threshold(model, cells, 0.85) == pytest.approx(model.margin((1, 1)))
    assert boosting.threshold(model, cells, 0.99) is None
    assert boosting.fit([]).margin((0,)) == 0


def test_weak_candidates_need_a_complement_in_their_scope(spark):
    value = "aB3dE6gH9jK2mN5pQ8sT"
    rows = [
        (1, f"user = admin1 and then {value} here"),
        (2, f"nothing else than {value} here"),
        (3, f"user = admin1 {'x ' * 150}{value}"),
        (4, f"user = admin1\n\n{value}"),
        (5, f"see https://db.example.org:5432/x {value}"),
        (6, "host: db.internal pass: hunter"),
        (7, "pass: hunter"),
        (8, f"user = admin1 token = {value}"),
        (9, f"{'y ' * 95}{value} {'z ' * 60} login: root"),
    ]
    got = {r.doc_id: [s.kind for s in r.spans] for r in secrets.find_secrets(table(spark, rows)).collect()}
    assert got == {1: ["weak"], 2: [], 3: [], 4: [], 5: ["weak"], 6: ["weak"], 7: [], 8: ["assign"], 9: ["weak"]}


def test_queries_are_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in llm_queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(ORACLE) <= set(llm_queries.QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "tokens"]


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage was given and what it returned, over the small tables."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, step in corpus_pipeline.STAGES:
        after = stage(step(spark, docs, SMALL), name)
        out.append((docs, after))
        docs = after
    return out


def test_rejected_documents_go(spark, stages):
    docs, after = stages[0]
    model = quality.train_on_labels(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    scores = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert {r.doc_id for r in after.collect()} == {d for d, s in scores.items() if s >= corpus_pipeline.REJECT_BELOW}
    assert after.columns == docs.columns


def test_one_of_each_group_stays(stages):
    docs, after = stages[1]
    want = {d for d, _, _, kept in brute_components([(r.doc_id, r.text) for r in docs.collect()], 5, 80) if kept}
    assert {r.doc_id for r in after.collect()} == want and after.count() == len(want)


def test_benchmark_texts_go(spark, stages):
    docs, after = stages[2]
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    left = {r.doc_id for r in after.collect()}
    plain = lambda t: " ".join(words(t))
    for r in docs.collect():
        if any(plain(x) in plain(r.text) for x in items):
            assert r.doc_id not in left
    gone = {r.doc_id for r in docs.collect()} - left
    for r in docs.where(docs.doc_id.isin([*gone][:3])).collect():
        assert any(edit_search(plain(x), plain(r.text)) <= 0.08 * len(plain(x)) for x in items)


def test_mix_and_tokens(stages):
    docs, after = stages[3]
    taken = {r.doc_id: r.taken for r in mixing.mix_sizes(docs).collect()}
    got = Counter()
    for r in after.collect():
        got[r.doc_id] += len(words(r.text))
    assert {d: n for d, n in taken.items() if n} == {d: n for d, n in got.items() if n}
    texts = Counter((r.doc_id, len(plain_ids(r.text))) for r in after.collect())
    rows = stages[4][1].collect()
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == texts
    assert sorted(r.start for r in rows)[-1] == sum(r.n_tokens for r in rows) - max(rows, key=lambda r: r.start).n_tokens
