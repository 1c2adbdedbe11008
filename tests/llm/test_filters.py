"""Quality, near-duplicates and decontamination against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.llm import decontam, neardup, quality
from sievework.llm.hashing import word_hashes

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return WORD.findall(lower(text or ""))


def prose(rng, n):
    return " ".join("".join(rng.choice(["ta", "ri", "mo", "el", "su"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbZé \t\n\x0b\x1c!", max_size=30)), max_size=8))
def test_words_are_cut_and_told_apart_as_stated(texts):
    at, hashes = word_hashes(pa.array(texts, pa.string()))
    want = [words(t) for t in texts]
    assert [b - a for a, b in zip(at[:-1], at[1:])] == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    assert len(set(flat)) == len(set(hashes.tolist()))
    assert len(set(zip(flat, hashes.tolist()))) == len(set(flat))


def test_words_of_a_text_longer_than_a_segment():
    text = " ".join(f"w{i}" for i in range(400_000)) + " " + "x" * 3_000_000
    at, hashes = word_hashes(pa.array(["a b", text, ""]))
    assert at.tolist() == [0, 2, 400_003, 400_003]
    assert len(np.unique(hashes)) == 400_003
    assert hashes[2] == word_hashes(pa.array(["w0"]))[1][0]


# --- near duplicates --------------------------------------------------------


def brute_components(rows, n, threshold):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= threshold * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    label = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            label[root(i)] = min(label.get(root(i), d), d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = label.get(root(i)) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


def near_rows(seed):
    rng = random.Random(seed)
    rows, shared = [], prose(rng, 60)
    for i in range(150):
        kind = rng.random()
        if kind < 0.35 and rows:
            w = (rng.choice(rows)[1] or "a b").split(" ")
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(["zzz", "yyy"])
            rows.append((i, " ".join(w)))
        elif kind < 0.5:
            rows.append((i, shared + " " + prose(rng, 30)))
        else:
            rows.append((i, prose(rng, rng.choice([1, 2, 3, 40, 90]))))
    base = prose(rng, 120).split(" ")
    for i in range(150, 230):
        w = list(base)
        w[rng.randrange(120)] = f"q{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    return rows + [(900, None), (901, ""), (902, " \n\t"), (903, "A b C"), (904, "a B c"), (905, "one"), (906, "One")]


def test_near_duplicates_equal_all_pairs(spark):
    rows = near_rows(5)
    for n, threshold in ((3, 0.85), (5, 0.8)):
        got = neardup.near_duplicates(table(spark, rows), n, threshold).collect()
        assert sorted([tuple(r) for r in got], key=str) == brute_components(rows, n, round(100 * threshold))


def test_dense_regions_are_searched_by_differences(spark, monkeypatch):
    monkeypatch.setattr(neardup, "DIRECT", 4)
    rows = near_rows(6)
    got = neardup.near_duplicates(table(spark, rows), 3, 0.85).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_components(rows, 3, 85)


def crowd(seed, n=150, edits=6):
    """Copies of one text around the threshold, some with later changes of their own."""
    rng = random.Random(seed)
    base = prose(rng, 150).split(" ")
    texts = [base]
    while len(texts) < n:
        w = list(base if rng.random() < 0.7 else rng.choice(texts))
        for _ in range(rng.randint(1, edits)):
            w[rng.randrange(len(w))] = f"q{rng.randrange(400)}"
        texts.append(w + prose(rng, rng.choice([1, 1, 20])).split(" "))
    return [(i, " ".join(w)) for i, w in enumerate(texts)]


@pytest.mark.parametrize("seed,n,threshold", [(1, 3, 0.85), (2, 5, 0.8), (3, 3, 0.85)])
def test_differences_find_every_link_of_a_crowd(spark, seed, n, threshold):
    """Against all pairs, each text a component of its own, so no other step can help."""
    rows = crowd(seed)
    per_cent = round(100 * threshold)
    docs = table(spark, rows).select("doc_id", "text")
    offsets, hashes = neardup.shingle_sets(pa.array([t for _, t in rows]), n)
    sets = [frozenset(hashes[x:y].tolist()) for x, y in zip(offsets[:-1], offsets[1:])]
    keys = [bytes(k) for k in neardup.set_keys(offsets, hashes)]
    unique = sorted({k: i for i, k in reversed(list(enumerate(keys)))}.values())
    nodes = spark.createDataFrame(
        [(keys[i], i, len(sets[i]), i) for i in unique], "cls binary, rep bigint, n int, comp bigint"
    )
    pivot = keys[unique[len(unique) // 2]]
    crowded = spark.createDataFrame([(pivot, keys[i]) for i in unique if keys[i] != pivot], "u binary, v binary")
    found = {frozenset((bytes(r.u), bytes(r.v))) for r in neardup._by_differences(docs, nodes, crowded, n, per_cent).collect()}
    linked = set()
    for i in unique:
        for j in unique:
            both = len(sets[i] & sets[j])
            if i < j and 100 * both >= per_cent * len(sets[i] | sets[j]):
                linked.add(frozenset((keys[i], keys[j])))
    with_pivot = {k for pair in linked if pivot in pair for k in pair}
    missing = [pair for pair in linked - found if not pair <= with_pivot]
    assert len(linked) > 50 and missing == []
    assert len(found) < len(unique) * (len(unique) - 1) // 4


def test_shingles_are_counted_without_rows_of_their_own(spark):
    """A task gives a row for each stretch of places at most, and the rows add up."""
    rng = random.Random(9)
    lists = [rng.sample(range(-(1 << 40), 1 << 40), 400) + [5, -7] for _ in range(20)]
    schema = pa.schema([("salt", pa.int64()), ("items", pa.list_(pa.int64()))])
    batch = pa.RecordBatch.from_pylist([{"salt": 3, "items": own} for own in lists], schema)
    rows = [r for b in neardup._counted([batch.slice(0, 7), batch.slice(7)]) for r in b.to_pylist()]
    assert len(rows) <= neardup.PLACES // neardup.STRETCH and sum(sum(r["often"]) for r in rows) == 20 * 402
    want = Counter((x ^ 3) & (neardup.PLACES - 1) for own in lists for x in own)
    sets = spark.createDataFrame([(3, own) for own in lists], "salt bigint, items array<bigint>").repartition(4)
    seen = neardup._often(sets)
    assert {int(p): int(seen[p]) for p in np.flatnonzero(seen)} == {p: k for p, k in want.items() if k > 1}


def test_only_beginnings_of_differences_become_rows(spark):
    """Sets sorted from the rarest shingle on; the rest is neither joined nor made rows of."""
    rng = random.Random(8)
    lists = [sorted(rng.sample(range(1000, 1400), 60)) for _ in range(30)] + [[7, 8, 9]]
    rows = [(bytes([1]), bytes([k]), k, 100, len(own), 5, own) for k, own in enumerate(lists)]
    sets = spark.createDataFrame(rows, "pivot binary, cls binary, comp bigint, n int, m bigint, salt bigint, items array<bigint>")
    seen = neardup._often(sets)
    count = {x: sum(x in own for own in lists) for own in lists for x in own}
    assert all(seen[(x ^ 5) & (neardup.PLACES - 1)] == (k if k > 1 else 0) for x, k in count.items())
    batch = pa.RecordBatch.from_pylist([r.asDict() for r in sets.collect()], pa.schema(
        [("pivot", pa.binary()), ("cls", pa.binary()), ("comp", pa.int64()), ("n", pa.int32()), ("m", pa.int64()), ("salt", pa.int64()), ("items", pa.list_(pa.int64()))]
    ))
    got = [(r["cls"][0], r["item"], r["place"], r["lately"]) for b in neardup.first_items(seen, 85)([batch]) for r in b.to_pylist()]
    want = []
    for k, own in enumerate(lists):
        order = sorted(own, key=lambda x: (count[x] if count[x] > 1 else 0, x))
        shared = [x for x in order if count[x] > 1]
        for place, x in enumerate(order[: 15 * 100 // 85 + 1]):
            if count[x] > 1:
                want.append((k, x, place, shared[max(shared.index(x) - neardup.BEFORE, 0) : shared.index(x)]))
    assert got == want and len(got) < sum(map(len, lists)) / 3


def test_signatures_are_staged_once(spark, monkeypatch):
    """What holds whole signatures is deleted when the next table that does is written."""
    gone, discard = [], neardup.discard
    monkeypatch.setattr(neardup, "discard", lambda rows: (gone.append(rows.columns), discard(rows)))
    got = neardup.near_duplicates(table(spark, near_rows(2)), 3, 0.85).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_components(near_rows(2), 3, 85)
    assert [("sig" in columns) for columns in gone] == [True, True]


def test_a_pair_that_shares_many_differences_is_one_row(spark):
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base), *(" ".join([*base[:186], *[f"z{i}" for i in range(14)], f"own{k}"]) for k in range(6))]
    docs = table(spark, list(enumerate(texts))).select("doc_id", "text")
    offsets, hashes = neardup.shingle_sets(pa.array(texts), 3)
    keys, sizes = [bytes(k) for k in neardup.set_keys(offsets, hashes)], np.diff(offsets).tolist()
    nodes = spark.createDataFrame([(k, i, sizes[i], i) for i, k in enumerate(keys)], "cls binary, rep bigint, n int, comp bigint")
    crowded = spark.createDataFrame([(keys[0], k) for k in keys[1:]], "u binary, v binary")
    got = [(bytes(r.u), bytes(r.v)) for r in neardup._by_differences(docs, nodes, crowded, 3, 85).collect()]
    among = [pair for pair in got if keys[0] not in pair]
    assert len(among) == len(set(among)) == 15


@pytest.mark.parametrize("threshold", [0.8, 0.85])
def test_the_sketch_loses_less_than_the_orders(threshold):
    n, differ = neardup.FUNCTIONS, (1 - threshold) * 15 / 16
    limit = neardup.sketch_limit(threshold)
    beyond = sum(math.comb(n, k) * differ**k * (1 - differ) ** (n - k) for k in range(limit + 1, n + 1))
    assert limit < n // 2 and beyond <= (1 - threshold**3) ** 16 / 10


def test_near_duplicates_with_missing_and_repeated_ids(spark):
    text = "a b c d e f g"
    rows = [(None, text), (7, text), (7, text), (3, "x y z u v w"), (None, "only null ids here now"), (7, "p q r s t")]
    got = {(r.doc_id, r.component_id, r.kept, r.n_shingles) for r in neardup.near_duplicates(table(spark, rows)).collect()}
    assert got == {(None, 7, False, 3), (7, 7, True, 3), (3, 3, True, 2), (None, None, True, 1), (7, 7, True, 1)}
    kept = neardup.drop_near_duplicates(table(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [3, 7]
    named = table(spark, rows).selectExpr("*", "1 AS h", "2 AS n", "3 AS rows", "4 AS least", "5 AS __id")
    again = neardup.drop_near_duplicates(named)
    assert again.columns[-5:] == ["h", "n", "rows", "least", "__id"] and again.count() == len(kept)


def test_near_duplicates_of_an_empty_table(spark):
    assert neardup.near_duplicates(table(spark, [])).collect() == []
    assert neardup.drop_near_duplicates(table(spark, [])).columns == [c.split()[0] for c in DOCS.split(", ")]


# --- quality ----------------------------------------------------------------


def labelled(spark, n=240):
    rng = random.Random(1)
    rows, marks = [], []
    for i in range(n):
        good = i % 3 != 0
        text = prose(rng, rng.randint(20, 60))
        rows.append((i, text if good else text.upper().replace(" ", "!! ")))
        marks.append((i, int(good)))
    return table(spark, rows), spark.createDataFrame(marks, "doc_id bigint, quality int")


def test_held_out_documents_are_told_apart(spark):
    docs, labels = labelled(spark)
    scored = quality.score(docs, quality.train_on_labels(docs, labels)).collect()
    wrong = sum((r.score >= 0.7) != (r.doc_id % 3 != 0) for r in scored)
    assert len(scored) == 240 and wrong <= 5


def test_quality_of_odd_rows(spark):
    docs, labels = labelled(spark, 60)
    model = quality.train_on_labels(docs, labels.unionByName(labels))
    odd = [(1, None), (1, ""), (None, " "), (2, "x" * 50_000), (2, "a b " * 30_000)]
    scored = quality.score(table(spark, odd), model).collect()
    assert len(scored) == 5 and all(0 <= r.score <= 1 for r in scored)
    assert len({r.score for r in scored[:3]}) == 1
    assert quality.keep_good(table(spark, odd), model, 0.0).count() == 5


def test_training_without_labels_gives_even_odds(spark):
    docs, labels = labelled(spark, 6)
    model = quality.train_on_labels(docs, labels.where("false"))
    assert quality.score(docs, model).first().score == pytest.approx(0.5)


def test_only_the_model_reaches_the_driver(spark, monkeypatch):
    rng = random.Random(5)
    docs = table(spark, [(i, prose(rng, 40)) for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int")
    frame, sizes = type(docs), []
    whole = frame.toArrow
    monkeypatch.setattr(frame, "toArrow", lambda self: sizes.append((t := whole(self)).num_rows) or t)
    model = quality.train_on_labels(docs, labels)
    assert sizes == [1] and np.count_nonzero(model.weights) > 0


def test_training_is_repeatable_and_bounded(spark):
    docs, labels = labelled(spark, 120)
    one = quality.train_on_labels(docs, labels, max_rows=30)
    two = quality.train_on_labels(docs.repartition(5), labels, max_rows=30)
    assert np.array_equal(one.weights, two.weights) and one.bias == two.bias


# --- decontamination --------------------------------------------------------


def edit_search(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="abc", min_size=1, max_size=12), st.text(alphabet="abc", max_size=30))
def test_bit_parallel_distance(pattern, text):
    assert decontam.best_match(pattern, text)[0] == edit_search(pattern, text)


def test_items_are_found_with_edits_and_nothing_else(spark):
    rng = random.Random(3)
    items = [(i, prose(rng, 14)) for i in range(12)]
    rows = [(i, prose(rng, 80)) for i in range(40)]
    for i in range(40, 80):
        item = list(items[i % 12][1])
        for _ in range(rng.randint(0, 9)):
            at = rng.randrange(len(item))
            item[at : at + rng.randint(0, 1)] = rng.choice(["x", "", "Q"])
        rows.append((i, prose(rng, 20) + " \n " + "".join(item).upper() + ". " + prose(rng, 20)))
    rows += [(90, None), (91, ""), (92, items[0][1] + " " + items[1][1])]
    bench = spark.createDataFrame([*items, (50, "short"), (51, None), (52, "")], "item_id bigint, text string")
    want = set()
    for d, t in rows:
        for i, x in items:
            pattern = decontam.normal(x)
            distance = edit_search(pattern, decontam.normal(t))
            if distance <= int(len(pattern) * decontam.ERROR_RATE):
                want.add((d, i, distance))
    docs = table(spark, rows)
    got = decontam.find_items(docs, bench).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in got} == want and len(want) > 20
    text = dict(rows)
    for r in got:
        assert edit_search(decontam.normal(dict(items)[r.item_id]), decontam.normal(text[r.doc_id][r.begin : r.end])) == r.distance
    clean = decontam.drop_contaminated(docs, bench)
    assert {r.doc_id for r in clean.collect()} == set(text) - {d for d, _, _ in want}
    assert clean.columns == docs.columns


def test_short_items_are_found_word_for_word(spark):
    docs = table(spark, [(1, "Well:  What is\n2+2? Four."), (2, "what is 2+3?"), (3, "concatenate, cat"), (4, "concatenate")])
    bench = spark.createDataFrame([(7, "what is 2+2?"), (8, "cat"), (9, " ")], "item_id bigint, text string")
    got = decontam.find_items(docs, bench).collect()
    assert {tuple(r) for r in got} == {(1, 7, 0, 7, 19), (3, 8, 0, 13, 16)}
    assert {r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()} == {2, 4}


def test_benchmark_in_blocks_and_empty(spark, monkeypatch):
    docs = table(spark, [(1, "the quick brown fox jumps over the dog"), (2, None)])
    bench = spark.createDataFrame([(i, f"the quick brown fox jumps over {'the dog' if i == 4 else i}") for i in range(9)], "item_id bigint, text string")
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 64)
    assert {(r.item_id, r.distance) for r in decontam.find_items(docs, bench, error_rate=0.0).collect()} == {(4, 0)}
    assert decontam.drop_contaminated(docs, bench.where("false")).count() == 2
