"""Tokens, language model, mixing, chat and search against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievework.llm import chat, hamming, lm, mixing, tokens

from .test_filters import DOCS, prose, table, words

# --- token files ------------------------------------------------------------

SPACES = "a  b\n\n c\t\td \x1c e f  g'll  's 12 34 é中 \n"


def plain_ids(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.vocabulary_path())
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [tokens.END_ID]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=" \t\n\r\x0b\x1c\x85\xa0 ab'sllé1.<|>", max_size=40))
def test_pieces_encode_like_the_whole(text):
    encoder = tokens.Encoder(tokens.vocabulary_path(), cache_pieces=3)
    got = np.frombuffer(encoder.encode([text, text])[1], "<u4").tolist()
    assert got == plain_ids(text)[:-1]


def test_new_words_go_straight_to_the_merges(tmp_path):
    """No cuts by the tokenizer for a word; other pieces, and words it would change, go the whole way."""
    text = "Straße über élan слово thingeare a" + "b" * 3000 + " x1 3.5 Don't"
    encoder = tokens.Encoder(tokens.vocabulary_path(), cache_pieces=2)
    whole, asked = encoder._ids, []
    encoder._ids = lambda piece: asked.append(piece) or whole(piece)
    assert encoder.encode([text])[0] == whole(text)
    assert asked == ["1", " 3.5", " Don't"] and len(encoder.known) == 2

    from tokenizers import Tokenizer, normalizers

    other = Tokenizer.from_file(tokens.vocabulary_path())
    other.normalizer = normalizers.Lowercase()
    other.save(str(tmp_path / "lower.json"))
    lower = tokens.Encoder(str(tmp_path / "lower.json"))
    assert lower.encode(["Some Words"])[0] == encoder.encode(["some words"])[0] != encoder.encode(["Some Words"])[0]


def test_a_word_is_one_piece_whatever_sign_follows():
    encoder = tokens.Encoder(tokens.vocabulary_path())
    texts = ["a word, a word. a word! a word", "été, été? cafe\u0301, слово. слова\u0301 naïveꙁ, x\u00d7y a1,b2 don't, \u01c5z."]
    got = [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(texts)]
    assert got == [plain_ids(t)[:-1] for t in texts]
    assert sum("word" in piece for piece in encoder.known) == 1


def test_token_files_round_trip(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(0, 50))) for i in rng.sample(range(500), 60)]
    rows += [(501, None), (502, ""), (503, SPACES), (504, "<|endoftext|> x"), (7000, "word " * 20_000), (None, "no id"), (501, "again"), (501, None)]
    docs = table(spark, rows).repartition(5)
    path = str(tmp_path / "tokens")
    tokens.write_tokens(docs, path)
    got = sorted(tokens.read_tokens(spark, path).collect(), key=lambda r: r.start)
    at, keys = 0, []
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += len(r.ids)
        keys.append(-1 if r.doc_id is None else r.doc_id)
    assert keys == sorted(keys)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((d, tuple(plain_ids(t))) for d, t in rows)
    sums = {(r.doc_id, r.start): r.ids_crc32 for r in tokens.digests(tokens.read_tokens(spark, path)).collect()}
    assert sums == {(r.doc_id, r.start): zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got}


def test_token_files_keep_indexes_and_are_pruned(spark, tmp_path):
    """Rows that the scan itself gives, before the filter above it."""
    path = str(tmp_path / "tokens")
    tokens.write_tokens(table(spark, [(2 * i, f"text {i}") for i in range(25_000)]).coalesce(1), path)

    def scanned(condition):
        found = spark.read.orc(path).where(condition).select("n_tokens")
        rows = found.collect()
        scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
        return len(rows), scan.metrics().get("numOutputRows").get().value()

    assert scanned("true") == (25_000, 25_000)
    one, read = scanned("doc_id = 34")
    assert one == 1 and read <= 10_000
    # Odd ids lie between the least and the largest of a row group: only Bloom filters rule them out.
    missing = [scanned(f"doc_id = {2 * i + 1}") for i in range(0, 20_000, 1_000)]
    assert all(found == 0 for found, _ in missing) and sum(read == 0 for _, read in missing) >= 15
    assert "EqualTo(doc_id,17)" in tokens.read_tokens(spark, path).where("doc_id = 17")._jdf.queryExecution().toString()


def test_token_files_of_an_empty_table(spark, tmp_path):
    tokens.write_tokens(table(spark, []), str(tmp_path / "none"))
    assert tokens.read_tokens(spark, str(tmp_path / "none")).collect() == []


# --- language model ---------------------------------------------------------


def test_base_scores_and_counts(spark, monkeypatch):
    monkeypatch.setattr(lm, "TABLE_WORDS", 12)
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(0, 40))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, "Never seen before"), (72, "Never seen before"), (None, "x y"), (73, "tari " * 9_000)]
    docs = table(spark, rows)
    train = [t for d, t in rows if d is not None and d % 3]
    c = Counter(w for t in train for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    got = lm.score_texts(docs, docs.where("doc_id % 3 != 0")).collect()
    want = Counter()
    for d, t in rows:
        seq = [*words(t), None]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in seq)
        want[(d, len(seq), sum(c[w] > 0 for w in seq), n, round(base, 6))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_probabilities_add_up_to_one(spark):
    rng = random.Random(5)
    docs = table(spark, [(i, prose(rng, 30)) for i in range(40)])
    vocabulary = lm.build_vocabulary(lm.count_words(docs))
    flat = lm.train_round(docs, vocabulary, lm.Parameters.start(vocabulary.unigram()).flat, 1)
    scorer = lm.Scorer(vocabulary, flat)
    t = np.arange(lm.SYMBOLS)
    for s1, s2 in ((0, 0), (3, 0), (5, 2040)):
        total = (10.0 ** scorer.symbol_scores(np.full_like(t, s1), np.full_like(t, s2), t).astype(float)).sum()
        assert total == pytest.approx(1, abs=1e-3)


def test_models_of_many_tasks_are_averaged_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(lm, "FAN", 4)
    rng = np.random.default_rng(3)
    parts = rng.normal(size=(2, 70, 5)).astype(np.float32)
    weights = rng.integers(1, 1000, 70).astype(float)
    tasks = [t for t in range(70) if t % 9 != 4]
    rows = [(b, t, float(weights[t]), bytearray(parts[b, t].tobytes())) for b in (0, 1) for t in tasks]
    got = lm.averaged(spark.createDataFrame(rows, lm.MODELS)).collect()
    assert sorted(r.block for r in got) == [0, 1]
    for r in got:
        want = np.average(parts[r.block][tasks], axis=0, weights=weights[tasks])
        assert np.allclose(np.frombuffer(r.part, np.float32), want, atol=1e-5)
        assert r.weight == weights[tasks].sum()
    assert lm.averaged(spark.createDataFrame([], lm.MODELS)).collect() == []


def test_the_model_learns_an_order_of_words(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["red apple", "blue sky", "green leaf"]) for _ in range(400))) for i in range(60)]
    docs = table(spark, rows)
    got = lm.score_texts(docs, docs.where("doc_id < 50")).where("doc_id >= 50").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1] * 0.9


def test_language_model_without_texts(spark):
    docs = table(spark, [(1, "a b"), (2, None)])
    got = {r.doc_id: r for r in lm.score_texts(docs, docs.where("false")).collect()}
    assert got[1].n_known == 0 and got[1].train_tokens == 0 and got[2].n_tokens == 1
    assert lm.score_texts(docs.where("false"), docs).collect() == []


# --- mixing -----------------------------------------------------------------


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, left = sum(sizes.values()), {}, set(names)
    while left:
        rest = total - sum(target.values())
        share = {s: rest * w[s] / sum(w[x] for x in left) for s in left}
        over = {s for s in left if share[s] > cap * sizes[s]}
        target.update({s: cap * sizes[s] for s in over} if over else share)
        left = left - over if over else set()
    return target


def test_targets_and_taken_words(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randint(0, 60)), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(600)]
    rows += [(900, None, "a"), (901, "", "zero"), (None, "x y z", "b"), (902, "tiny source", "Z")]
    docs = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], DOCS).withColumn("size", F.lit("clash"))
    got = mixing.mix_sizes(docs).collect()
    again = mixing.mix_sizes(docs.repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    source = {(i, len(words(t))): s for i, t, s in rows}
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want = plain_targets(sizes)
    taken = Counter()
    for r in got:
        s = source[(r.doc_id, r.size)]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 60 for s in sizes)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(words(r.text)) for r in mixed.collect()) == sum(taken.values())


def test_better_documents_are_taken_more_often(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, 20) if i % 2 else prose(rng, 20).replace(" ", " ## $$ "), "a") for i in range(400)]
    rows += [(i, prose(rng, 20), "b") for i in range(1000, 1040)]
    docs = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], DOCS)
    got = mixing.mix_sizes(docs, weights=(1, 1), max_epochs=3).where("doc_id < 1000").collect()
    share = [sum(r.taken > 0 for r in got if r.doc_id % 2 == k) / 200 for k in (0, 1)]
    assert share[1] >= share[0] + 0.1


def test_of_equal_rows_as_many_are_taken_as_fit(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 70)
    rng = random.Random(18)
    same = prose(rng, 10)
    rows = [(i, prose(rng, 12), "a") for i in range(900)] + [(5000, same, "b")] * 900
    rows += [(6000 + i, prose(rng, 9), "c") for i in range(300)] + [(None, "no id " * 5, "c")] * 300
    docs = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], DOCS)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    source = {len(words(t)) * 10_000 + (i or 0): s for i, t, s in rows}
    for weights in ((9, 2, 1), (1, 30, 1)):
        want = plain_targets(sizes, weights)
        got = mixing.mix_sizes(docs, weights=weights).collect()
        assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix_sizes(docs.repartition(5), weights=weights).collect()))
        assert len(got) == len(rows)
        taken = Counter()
        for r in got:
            assert 0 <= r.taken <= 3 * r.size
            taken[source[r.size * 10_000 + (r.doc_id or 0)]] += r.taken
        assert all(abs(taken[s] - want[s]) <= 12 for s in sizes), (weights, taken, want)
        mixed = Counter(r.source for r in mixing.mix_documents(docs, weights=weights).collect() for _ in words(r.text))
        assert mixed == +taken


CLASHES = ["size", "budget", "target", "epochs", "last", "cut_fine", "p_source", "source_size", "words", "__key", "__size", "e_n"]


def test_mixing_keeps_columns_of_any_name(spark):
    rng = random.Random(19)
    rows = [(i, prose(rng, 8), rng.choice("ab"), *[f"{c}{i}" for c in CLASHES]) for i in range(60)]
    schema = "doc_id bigint, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES)
    mixed = mixing.mix_documents(spark.createDataFrame(rows + rows[:20], schema), weights=(1, 4))
    assert mixed.columns == ["doc_id", "text", "source", *CLASHES]
    assert set(map(tuple, mixed.collect())) <= set(rows)
    assert len(mixing.mix_sizes(spark.createDataFrame(rows, schema)).collect()) == 60


def test_mixing_an_empty_table(spark):
    assert mixing.mix_sizes(table(spark, [])).collect() == []
    assert mixing.mix_documents(table(spark, [])).collect() == []


# --- chat -------------------------------------------------------------------

TURNS = "conv_id bigint, turn bigint, role string, text string, piece string"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<|\\>im_endstart \n%0A", max_size=30))
def test_escapes_are_reversible(text):
    out = chat.escape(text)
    assert chat.START not in out and chat.END not in out and chat.unescape(out) == text
    role = chat.escape_role(text)
    assert "\n" not in role and chat.unescape_role(role) == text


def test_conversations_round_trip(spark):
    rng = random.Random(9)
    rows = []
    for c in range(25):
        for t in range(rng.randint(1, 12)):
            role = rng.choice(["user", "assistant", "system", "assistant", None, "a\nb"])
            rows.append((c, t, role, rng.choice([None, "", "<|im_end|>\n", "hi <\\| there", "ü" * 40]), "x"))
    rows += [(None, None, "assistant", "no id", "x"), (3, 0, "assistant", "tie", "x"), (3, 0, "assistant", "tie", "x")]
    turns = spark.createDataFrame(rows, TURNS)
    pieces = chat.format_turns(turns.repartition(4))
    got = {r.conv_id: r for r in chat.digests(pieces, chat.examples(pieces)).collect()}
    key = lambda r: tuple((x is not None, x) if x is not None else (False, 0 if isinstance(x, int) else "") for x in r[1:4])
    spelled = {}
    for r in chat.example_texts(pieces).collect():
        spelled.setdefault(r.conv_id, []).append(r)
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=key)
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        reply = [r[3] or "" for r in own if r[2] == "assistant"]
        g = got[c]
        assert (g.n_turns, g.turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len("".join(reply)), hashlib.sha256("".join(reply).encode()).hexdigest())
        full = sorted(spelled.get(c, []), key=lambda r: r.target)
        assert [chat.unescape(r.text[r.context_end : r.reply_end]) for r in full] == reply
        assert g.n_examples == len(reply) and g.example_chars == sum(len(r.text) for r in full)
        assert all(r.text.count(chat.START) == r.target + 1 for r in full)


def test_chat_of_an_empty_table(spark):
    pieces = chat.format_turns(spark.createDataFrame([], TURNS))
    assert chat.digests(pieces, chat.examples(pieces)).collect() == []


def test_a_hot_conversation_is_split_and_read_through_its_examples(spark, monkeypatch):
    roles = ["user", "assistant", "system"]
    rows = [(7 if i % 3 else i, i, roles[i % 3], f"turn {i}" * (i % 5), "x") for i in range(6000)]
    seen, in_parts = [], chat._in_parts
    monkeypatch.setattr(chat, "_in_parts", lambda turns: seen.append(in_parts(turns)) or seen[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pieces = chat.format_turns(spark.createDataFrame(rows, TURNS))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert seen[0].where("conv_id = 7").select("part").distinct().count() > 1
    hot = sorted((r for r in pieces.collect() if r.conv_id == 7), key=lambda r: r.n)
    assert [r.n for r in hot] == list(range(4000))
    assert [r.begin for r in hot] == [sum(len(h.piece) for h in hot[:i]) for i in range(len(hot))]
    chosen = chat.examples(pieces)
    one = chat.digests(pieces, chosen).where("conv_id = 7").first()
    said = [r[3] for r in rows if r[0] == 7 and r[2] == "assistant"]
    assert (one.n_examples, one.loss_sha256) == (2000, hashlib.sha256("".join(said).encode()).hexdigest())
    # Only what the examples name is trainable.
    few = chat.digests(pieces, chosen.where("target < 2")).where("conv_id = 7").first()
    assert (few.n_turns, few.n_examples, few.loss_chars) == (4000, 1, len(said[0]))


# --- nearest codes ----------------------------------------------------------


def test_nearest_codes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hamming, "INDEX_ROWS", 150)
    monkeypatch.setattr(hamming, "BLOCK_QUERIES", 4)
    rng = np.random.default_rng(1)
    center = rng.normal(size=(8, 40))
    v = center[rng.integers(0, 8, 500)] + rng.normal(scale=0.7, size=(500, 40))
    v[100:180] = v[100]
    rows = [(int(i), [float(x) for x in r], "c") for i, r in enumerate(v)]
    odd = [(900, None, "c"), (901, [], "c"), (902, [1.0], "c"), (None, rows[0][1], "c"), (rows[5][0], rows[5][1], "c")]
    table_ = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>, distance string")
    got = hamming.nearest_codes(table_, F.col("vec_id") % 20 == 0, k=7).collect()
    code = v >= 0
    for q in range(0, 500, 20):
        far = (code != code[q]).sum(axis=1)
        want = [(int(far[i]), i) for i in sorted(range(500), key=lambda i: (far[i], i)) if i != q][:7]
        assert [(r.distance, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want


def test_nearest_codes_in_batches_of_mostly_another_length(spark, monkeypatch):
    monkeypatch.setattr(hamming, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 24))
    long = [(i, [float(x) for x in v[i]]) for i in range(60)]
    short = [(1000 + i, [1.0, -1.0]) for i in range(200)]
    rows = spark.createDataFrame(long + short, "vec_id bigint, embedding array<double>").coalesce(1)
    asked = F.col("vec_id").isin(0, 10, 20, 30, 40, 1000, 1001, 1002)
    got = hamming.nearest_codes(rows, asked, k=5).collect()
    code = v >= 0
    want = set()
    for q in range(0, 50, 10):
        far = (code != code[q]).sum(axis=1)
        near = [i for i in sorted(range(60), key=lambda i: (far[i], i)) if i != q][:5]
        want |= {(q, n, i, int(far[i])) for n, i in enumerate(near, 1)}
    assert {tuple(r) for r in got} == want


def test_nearest_codes_of_few_rows(spark):
    few = spark.createDataFrame([(0, [1.0, -1.0]), (1, [1.0, 1.0])], "vec_id bigint, embedding array<double>")
    assert [tuple(r) for r in hamming.nearest_codes(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 1)]
    assert hamming.nearest_codes(few.where("false"), F.lit(True)).collect() == []
