"""Fill-in-the-middle texts, vector codes and projected search against plain versions."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import fim, projected, queries, vectorcodes

# --- fill in the middle -----------------------------------------------------


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def fim_rows():
    rng = random.Random(1)
    alphabet = ["a", "Bc", "<", ">", "P", "S", "M", "<P", "é", "中", "😀", "\n", "\r\n", " ", "\\", "$1", "0", "\x85", "\x00"]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    rows += [(1000 + i, t) for i, t in enumerate(["", None, "<P>", "x<S>y", "<M", "<<<P", "a" * 9, "$", "\\1", "<<S", "S>"] * 4)]
    rows += [(3, "again"), (3, "again"), (None, "no id here"), (None, None)]
    rows += [(2000 + i, t) for i, t in enumerate(["a " * 300_000, "x" * 400_000, "😀" * 50_000, "<" * 70_000])]
    return rows


def test_fill_in_middle_agrees_with_a_plain_version(spark):
    rows = fim_rows()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id bigint, text string, output string, n int")
    got = fim.fill_in_middle(docs.repartition(3)).collect()
    assert Counter(tuple(r) for r in got) == Counter(plain_fim(d, t) for d, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_is_reversible(spark):
    rows = fim_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = fim.digests(fim.fill_in_middle(docs)).collect()

    def digest(text):
        return hashlib.sha256((text or "").encode()).hexdigest()

    assert Counter((r.doc_id, r.restored_sha256) for r in got) == Counter((d, digest(t)) for d, t in rows)


def test_fill_in_middle_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert fim.digests(fim.fill_in_middle(docs)).collect() == []


# --- vector codes -----------------------------------------------------------


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """rows: (id, vector, label) of equal length; in whole numbers, one by one."""
    whole = [[math.floor(1024 * x) for x in v] for _, v, _ in rows]
    width = len(whole[0]) // parts
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    books = [[whole[i][p * width : (p + 1) * width] for i in order] for p in range(parts)]

    def assign(point, book):
        return min((sum((x - y) ** 2 for x, y in zip(point, e)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for v in whole:
                point = v[p * width : (p + 1) * width]
                members.setdefault(assign(point, books[p])[1], []).append(point)
            books[p] = [
                [sum(c) // len(members[j]) for c in zip(*members[j])] if j in members else e
                for j, e in enumerate(books[p])
            ]
    out = []
    for (id, _, label), v in zip(rows, whole):
        best = [assign(v[p * width : (p + 1) * width], books[p]) for p in range(parts)]
        out.append((id, label, "".join(f"{j:02x}" for _, j in best), sum(d for d, _ in best)))
    text = ",".join(str(x) for b in books for e in b for x in e)
    per_label = Counter()
    for _, label, _, error in out:
        per_label[label] += error
    digest = hashlib.sha256(text.encode()).hexdigest()
    return Counter((id, code, error, per_label[label], digest) for id, label, code, error in out)


SCHEMA = "vec_id bigint, embedding array<float>, label int, row string, part int, error double"


def vector_table(spark, rows):
    return spark.createDataFrame([(*r, "extra", 9, 0.5) for r in rows], SCHEMA)


def float32(values):
    return [float(np.float32(x)) for x in values]


def test_vector_codes_agree_with_a_plain_version(spark):
    rng = random.Random(3)
    rows = [(i, float32(rng.gauss(rng.choice([-2, 0, 3]), 0.3) for _ in range(8)), i % 5) for i in range(500)]
    rows += [(1000, [0.25] * 8, None)] * 3 + [(1000, [-0.5] * 8, 1), (None, [0.125] * 8, None)]
    # A point that a third of all rows share, and values far outside the first codebooks.
    rows += [(2000 + i, rows[7][1], 2) for i in range(250)]
    rows += [(3000, float32([900.0, -900.0] * 4), 3), (3001, float32([-0.0001] * 8), 3)]
    odd = [
        (0, None, 1), (1, [None] + [1.0] * 7, 1), (2, [float("nan")] * 8, 1), (3, [float("inf")] * 8, 1),
        (4, [], 1), (5, [1.0] * 4, 1), (6, [1.0] * 6, 1), (7, [-float("inf")] * 8, None),
    ]
    found, books = vectorcodes.compress(vector_table(spark, rows + odd).repartition(3))
    got = vectorcodes.with_label_error(found, books).collect()
    assert Counter(tuple(r) for r in got) == plain_codes(rows)


def test_few_and_no_vectors(spark):
    rows = [(5, [1.0, 2.0, 3.0, 4.0], 1), (3, [0.0, 0.5, -0.5, 1.0], None)]
    got = vectorcodes.with_label_error(*vectorcodes.compress(vector_table(spark, rows))).collect()
    assert Counter(tuple(r) for r in got) == plain_codes(rows)
    none = vectorcodes.with_label_error(*vectorcodes.compress(vector_table(spark, [(1, None, 1), (2, [1.0], 1)])))
    assert none.collect() == []
    assert none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_very_large_components_have_a_defined_code(spark):
    rows = [(i, [3e38 * (-1) ** i, 1.0, 2.0, 3.0], 1) for i in range(4)]
    got = vectorcodes.with_label_error(*vectorcodes.compress(vector_table(spark, rows))).collect()
    assert [r.error for r in got] == [0] * 4


def test_hilbert_keys_visit_neighbours():
    for axes, bits in ((2, 3), (3, 2), (1, 4)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
        keys = [k.tobytes() for k in vectorcodes.hilbert_keys(cells, bits)]
        assert len(set(keys)) == len(cells)
        walk = cells[np.argsort(np.array(keys, dtype=object), kind="stable")]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_shortlists_keep_every_nearest_entry():
    rng = np.random.default_rng(4)
    for _ in range(200):
        entries = rng.integers(-20, 20, (12, 3))
        points = rng.integers(-20, 20, (6, 3)) // rng.integers(1, 6)
        near = vectorcodes.shortlist(points.min(axis=0), points.max(axis=0), entries)
        far = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        nearest = np.nonzero(far == far.min(axis=1)[:, None])[1]
        assert set(nearest.tolist()) <= set(near.tolist())


@pytest.mark.parametrize("size", [1 << 10, 1 << 27])
def test_distances_are_exact(size):
    rng = np.random.default_rng(5)
    points, entries = rng.integers(-size, size, (20, 4)), rng.integers(-size, size, (9, 4))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, e)) for e in entries] for p in points]
    assert vectorcodes.distances(points, entries).tolist() == want


# --- projected search -------------------------------------------------------


def plain_nearest(rows, k, is_query):
    usable = {}
    for id, v in rows:
        if id is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        usable.setdefault(id, set()).add(tuple(v))
    out = {}
    for id in usable:
        if not is_query(id):
            continue
        q = np.array(min(usable[id]))
        scored = {}
        for other, vs in usable.items():
            if other != id:
                for v in vs:
                    v = np.array(v)
                    c = (v * q).sum() / (np.sqrt((v * v).sum()) * np.sqrt((q * q).sum()))
                    scored[other] = max(scored.get(other, -2), c)
        best = sorted(scored.items(), key=lambda s: (-s[1], s[0]))[:k]
        out[id] = [(i + 1, o, s) for i, (o, s) in enumerate(best)]
    return out


def searched(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def embeddings(spark, rows):
    return spark.createDataFrame(
        [(i, v, 1, 2.0, "x") for i, v in rows],
        "vec_id bigint, embedding array<float>, id int, score double, query_id string",
    )


def odd_vectors(rng):
    rows = [(i, float32(rng.gauss(0, 1) for _ in range(16))) for i in range(1500)]
    # Many rows with one vector, among them queries; the smallest ids must win.
    rows += [(3000 + i, rows[50][1]) for i in range(700)]
    rows += [(10, rows[10][1]), (5000, None), (5050, [0.0] * 16), (5100, [None] + [1.0] * 15), (None, [1.0] * 16)]
    rows += [(5150, [float("nan")] * 16), (5200, [float("inf")] + [1.0] * 15), (5250, []), (5300, [1.0] * 8)]
    rows += [(5350, float32([1e-38] * 16)), (5400, float32([1e38, -1e38] * 8)), (5401, float32([2e37, -2e37] * 8))]
    return rows


def test_certain_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(projected, "LEAF_ROWS", 20)
    rows = odd_vectors(random.Random(6))
    found = projected.nearest_cosine(
        embeddings(spark, rows).repartition(3), F.col("vec_id") % 50 == 0, k=5, confidence=1 - 1e-13
    )
    got = searched(found)
    want = plain_nearest([r for r in rows if r[1] is None or len(r[1]) != 8], 5, lambda i: i % 50 == 0)
    assert set(got) == set(want)
    for id in want:
        assert [(r, o) for r, o, _ in got[id]] == [(r, o) for r, o, _ in want[id]], id
        assert [s for _, _, s in got[id]] == pytest.approx([s for _, _, s in want[id]], abs=1e-14)


def test_recall_at_the_default_confidence(spark):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((10, 64))
    rows = [(i, float32(centres[i % 10] * 0.5 + rng.standard_normal(64))) for i in range(4000)]
    got = searched(projected.nearest_cosine(embeddings(spark, rows).repartition(2), F.col("vec_id") % 50 == 0))
    want = plain_nearest(rows, 5, lambda i: i % 50 == 0)
    hits = sum(len({o for _, o, _ in got[id]} & {o for _, o, _ in want[id]}) for id in want)
    assert hits >= 0.95 * 5 * len(want)


def test_queries_in_blocks_and_trees_of_few_rows(spark, monkeypatch):
    monkeypatch.setattr(projected, "BLOCK_BYTES", 2000)
    rng = random.Random(8)
    rows = [(i, float32(rng.gauss(0, 1) for _ in range(4))) for i in range(120)]
    got = searched(projected.nearest_cosine(embeddings(spark, rows), F.col("vec_id") % 7 == 0, k=3, confidence=1 - 1e-13))
    want = plain_nearest(rows, 3, lambda i: i % 7 == 0)
    assert {q: [o for _, o, _ in r] for q, r in got.items()} == {q: [o for _, o, _ in r] for q, r in want.items()}


def test_few_candidates_and_no_queries(spark):
    two = [(0, [1.0, 0.0]), (1, [0.0, 2.0])]
    assert searched(projected.nearest_cosine(embeddings(spark, two), F.col("vec_id") == 0)) == {0: [(1, 1, 0.0)]}
    for rows in ([], [(1, [1.0])], [(50, None)], [(50, [0.0])]):
        assert projected.nearest_cosine(embeddings(spark, rows), F.col("vec_id") % 50 == 0).collect() == []


def test_trees_hold_every_distinct_row():
    rng = np.random.default_rng(9)
    values = rng.integers(-2, 3, (3000, 3)).astype(float)
    values = values[(values != 0).any(axis=1)]
    ids = rng.permutation(len(values))
    kept = projected.few_of_each(ids, values, 2)
    by_vector = {}
    for i, v in zip(ids, values):
        by_vector.setdefault(tuple(v), []).append(i)
    assert sorted(ids[kept]) == sorted(i for v in by_vector.values() for i in sorted(v)[:3])


def test_quantiles():
    assert projected.quantile(0.95, 2) == pytest.approx(-2 * math.log(0.05))
    assert projected.chi_square(projected.quantile(0.98, 16), 16) == pytest.approx(0.98)


def test_the_queries_are_registered():
    assert {"op11_vector_codes", "op12_fill_in_middle", "op13_nearest_vectors"} <= set(queries.QUERIES)
