"""Log-bilinear language model, trained by noise-contrastive estimation.

Tokens are lower-cased words and one end per text. The model predicts a symbol from the
two symbols before it: the most frequent words have a symbol of their own, all others
share ``CLASSES`` symbols by their last letters, and within a shared symbol words follow
their smoothed counts, with one slot for unknown words. So the probabilities of all
words and slots add up to one, and a word seen nowhere has a probability too.

A symbol's score is (A[s1] + B[s2]) . Q[t] + b[t]. Training is noise-contrastive, in
numpy: each task runs over its own texts from the same start, and the parameters are
averaged, weighted by tokens; a short first round gives a common start for the round
over all the rest. As the score is a sum over the two context symbols, the normaliser
of every pair of symbols is one matrix product, exp(A Q) times exp(B Q + b), so log
probabilities are normalised exactly.

Word counts cover all training texts. Words with large counts, at most ``TABLE_WORDS``,
go to every task; occurrences of rarer words meet their counts in a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scale import stage
from .hashing import bound_batches, chunks, word_hashes

WORDS = 1983
CLASSES = 64
SYMBOLS = 1 + WORDS + CLASSES
END = 0
END_HASH = np.uint64(0x5EED0E4D5EED0E4D)
DIM = 24
TABLE_WORDS = 1 << 20
FLUSH = 1 << 21
BATCH = 8192
NOISE = 64
RATE = 0.15
WARM = 16
BLOCK = 4096
FAN = 64
MODELS = "block int, task int, weight double, part binary"
MAX_STEP = 4.0


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, hashes, tails) of words with an end after each text."""
    at, word, tail = word_hashes(column, tails=True)
    n = len(at) - 1
    place = at[1:]
    return at + np.arange(n + 1), np.insert(word, place, END_HASH), np.insert(tail, place, 0)


def _class_of(tails: np.ndarray) -> np.ndarray:
    return 1 + WORDS + (tails * 40503 // 64) % CLASSES


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, tail, c): word counts, merged within the task as far as memory allows."""
    parts, held = [], 0

    def merged():
        h, t, c = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.argsort(h, kind="stable")
        h, t, c = h[order], t[order], c[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        return h[first], t[first], np.add.reduceat(c, first)

    def emit(rows):
        h, t, c = rows
        for i in range(0, len(h), 1 << 16):
            cut = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[cut].view(np.int64)), pa.array(t[cut].astype(np.int32)), pa.array(c[cut])],
                names=["h", "tail", "c"],
            )

    for batch in batches:
        for part in chunks(batch, "text"):
            _, word, tail = _tokens(part.column("text"))
            h, first, c = np.unique(word, return_index=True, return_counts=True)
            parts.append((h, tail[first], c))
            held += len(h)
            if held > FLUSH:
                parts = [merged()]
                held = len(parts[0][0])
                if held > FLUSH // 2:
                    yield from emit(parts[0])
                    parts, held = [], 0
    if parts:
        yield from emit(merged())


class Vocabulary:
    """Frequent words with counts and symbols, sorted by hash, and the shared symbols' mass."""

    def __init__(self, hashes, counts, tails, mass: np.ndarray, tokens: int, types: int, known_from: int):
        order = np.argsort(hashes)
        self.hashes, self.counts, tails = hashes[order], counts[order], tails[order]
        ranked = np.lexsort((self.hashes, -self.counts))
        ranked = ranked[self.hashes[ranked] != END_HASH][:WORDS]
        self.symbols = _class_of(tails)
        self.symbols[ranked] = 1 + np.arange(len(ranked))
        self.symbols[self.hashes == END_HASH] = END
        self.own = np.zeros(SYMBOLS)
        self.own[self.symbols[ranked]] = self.counts[ranked]
        self.own[END] = self.counts[self.hashes == END_HASH].sum()
        self.mass = mass.copy()
        np.subtract.at(self.mass, _class_of(tails[ranked]), self.counts[ranked] + 0.5)
        self.mass[1 + WORDS :] += 0.5
        self.tokens, self.types, self.known_from = tokens, types, known_from

    def unigram(self) -> np.ndarray:
        """The share of each symbol, smoothed."""
        share = self.own + 0.5
        share[1 + WORDS :] = self.mass[1 + WORDS :]
        return share / share.sum()

    def look_up(self, words: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, symbol) of each word; the count is -1 where the table doesn't have it."""
        some, first, back = np.unique(words, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, some), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == some if len(self.hashes) else np.zeros(len(some), bool)
        count = np.where(known, self.counts[at] if len(self.hashes) else 0, -1)
        symbol = np.where(known, self.symbols[at] if len(self.hashes) else 0, _class_of(tails[first]))
        return count[back], symbol[back]


def count_words(docs: DataFrame) -> DataFrame:
    """(h, tail, c) over all texts of ``docs``."""
    return docs.select("text").mapInArrow(_counted, "h bigint, tail int, c bigint").groupBy("h", "tail").agg(
        F.sum("c").alias("c")
    )


def build_vocabulary(counts: DataFrame) -> Vocabulary:
    total = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    tokens, types = int(total[0] or 0), int(total[1] or 0)
    # As many rows as there are different counts; rarer ones are cut off at a count.
    sizes = counts.groupBy("c").agg(F.count(F.lit(1)).alias("n")).toArrow()
    known_from, held = 1 << 62, 0
    for c, n in sorted(zip(sizes.column("c").to_pylist(), sizes.column("n").to_pylist()), reverse=True):
        if held + n > TABLE_WORDS:
            break
        known_from, held = c, held + n
    often = counts.where((F.col("c") >= known_from) | (F.col("h") == int(END_HASH.view(np.int64)))).toArrow()
    mass = np.zeros(SYMBOLS)
    tails = counts.where(F.col("h") != int(END_HASH.view(np.int64))).groupBy("tail").agg(
        F.sum(F.col("c") + 0.5).alias("m")
    ).toArrow()
    np.add.at(mass, _class_of(tails.column("tail").to_numpy().astype(np.int64)), tails.column("m").to_numpy())
    return Vocabulary(
        often.column("h").to_numpy().view(np.uint64),
        often.column("c").to_numpy(),
        often.column("tail").to_numpy().astype(np.int64),
        mass,
        tokens,
        types,
        known_from,
    )


class Parameters:
    """A, B, Q (symbols x DIM) and b, as one vector."""

    SIZE = SYMBOLS * (3 * DIM + 1)

    def __init__(self, flat: np.ndarray):
        self.flat = flat
        self.a, self.b2, self.q = flat[: 3 * SYMBOLS * DIM].reshape(3, SYMBOLS, DIM)
        self.bias = flat[3 * SYMBOLS * DIM :]

    @classmethod
    def start(cls, unigram: np.ndarray) -> Parameters:
        rng = np.random.default_rng(3)
        flat = np.empty(cls.SIZE, np.float32)
        flat[: 3 * SYMBOLS * DIM] = rng.normal(0, 0.1, 3 * SYMBOLS * DIM)
        flat[3 * SYMBOLS * DIM :] = np.log(unigram)
        return cls(flat)


def _scatter(at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = np.empty((SYMBOLS, DIM), np.float32)
    for j in range(DIM):
        out[:, j] = np.bincount(at, rows[:, j], SYMBOLS)
    return out


class Trainer:
    """Noise-contrastive steps with per-parameter rates."""

    def __init__(self, flat: np.ndarray, unigram: np.ndarray, seed: int):
        self.p = Parameters(flat.copy())
        self.squares = np.full(Parameters.SIZE, 1.0, np.float32)
        self.noise = unigram
        self.log_noise = np.log(NOISE * unigram).astype(np.float32)
        self.edges = np.cumsum(unigram)
        self.rng = np.random.default_rng(seed)

    def step(self, s1: np.ndarray, s2: np.ndarray, t: np.ndarray) -> None:
        p, n = self.p, len(t)
        drawn = np.minimum(np.searchsorted(self.edges, self.rng.random(NOISE)), SYMBOLS - 1)
        r = p.a[s1] + p.b2[s2]
        true = np.einsum("ij,ij->i", r, p.q[t]) + p.bias[t] - self.log_noise[t]
        false = r @ p.q[drawn].T + p.bias[drawn] - self.log_noise[drawn]
        up = 1 / (1 + np.exp(np.clip(true, -30, 30)))
        down = -1 / (1 + np.exp(-np.clip(false, -30, 30)))
        to_r = up[:, None] * p.q[t] + down @ p.q[drawn]
        grad = np.empty(Parameters.SIZE, np.float32)
        g = Parameters(grad)
        g.a[:], g.b2[:] = _scatter(s1, to_r), _scatter(s2, to_r)
        g.q[:] = _scatter(t, up[:, None] * r)
        np.add.at(g.q, drawn, down.T @ r)
        g.bias[:] = np.bincount(t, up, SYMBOLS)
        np.add.at(g.bias, drawn, down.sum(axis=0))
        grad *= np.float32(64.0 / n)
        self.squares += grad * grad
        p.flat += RATE * grad / np.sqrt(self.squares)


def _context(offsets: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last and the second last symbol before each token; ends before a text's start."""
    s1 = np.empty_like(symbols)
    s1[1:], s1[:1] = symbols[:-1], END
    s2 = np.empty_like(symbols)
    s2[2:], s2[:2] = symbols[:-2], END
    begins = offsets[:-1]
    s1[begins] = END
    s2[begins] = END
    second = begins[np.diff(offsets) > 1] + 1
    s2[second] = END
    return s1, s2


def train_round(docs: DataFrame, vocabulary: Vocabulary, flat: np.ndarray, seed: int) -> np.ndarray:
    """One pass over ``docs``: every task from ``flat``, then the weighted mean."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((vocabulary, flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, flat = sent.value
        task = TaskContext.get().partitionId()
        trainer = Trainer(flat, vocabulary.unigram(), seed + task)
        seen = 0
        for batch in batches:
            for part in chunks(batch, "text"):
                offsets, word, tail = _tokens(part.column("text"))
                _, symbol = vocabulary.look_up(word, tail)
                s1, s2 = _context(offsets, symbol)
                order = trainer.rng.permutation(len(symbol))
                for i in range(0, len(order), BATCH):
                    at = order[i : i + BATCH]
                    trainer.step(s1[at], s2[at], symbol[at])
                seen += len(symbol)
        if seen:
            out = trainer.p.flat
            cut = [out[i : i + BLOCK].tobytes() for i in range(0, len(out), BLOCK)]
            n = len(cut)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(n, dtype=np.int32)),
                    pa.array(np.full(n, task, np.int32)),
                    pa.array(np.full(n, float(seen))),
                    pa.array(cut, pa.binary()),
                ],
                names=["block", "task", "weight", "part"],
            )

    parts = docs.select("text").mapInArrow(run, MODELS)
    rows = averaged(stage(parts, "models")).collect()
    if not rows:
        return flat
    return np.concatenate([np.frombuffer(r.part, np.float32) for r in sorted(rows, key=lambda r: r.block)])


def averaged(parts: DataFrame) -> DataFrame:
    """The weighted mean of each block over all tasks, as a tree: at most FAN parts meet in one group."""
    top = parts.agg(F.max("task")).first()[0] or 0
    while True:
        parts = parts.groupBy("block", F.floor(F.col("task") / FAN).alias("above")).applyInArrow(_mean, MODELS)
        if top < FAN:
            return parts
        top //= FAN


def _mean(found: pa.Table) -> pa.Table:
    found = found.sort_by("task")
    weight = found.column("weight").to_numpy()
    total = sum(
        w * np.frombuffer(x, np.float32).astype(float) for w, x in zip(weight, found.column("part").to_pylist())
    )
    return pa.table(
        {
            "block": found.column("block")[:1],
            "task": pa.array([found.column("task")[0].as_py() // FAN], pa.int32()),
            "weight": pa.array([weight.sum()]),
            "part": pa.array([(total / weight.sum()).astype(np.float32).tobytes()], pa.binary()),
        }
    )


class Scorer:
    """Log10 probabilities under fixed parameters; the normalisers are one matrix product."""

    def __init__(self, vocabulary: Vocabulary, flat: np.ndarray):
        self.vocabulary, self.p = vocabulary, Parameters(flat)
        left, right = self.p.a @ self.p.q.T, self.p.b2 @ self.p.q.T + self.p.bias
        top1, top2 = left.max(axis=1, keepdims=True), right.max(axis=1, keepdims=True)
        product = np.exp(left - top1) @ np.exp(right - top2).T
        self.log_z = np.log(product) + top1 + top2.T
        self.left, self.right = left, right

    def symbol_scores(self, s1: np.ndarray, s2: np.ndarray, t: np.ndarray) -> np.ndarray:
        return (self.left[s1, t] + self.right[s2, t] - self.log_z[s1, s2]) / np.log(10)


_scorer: tuple[int, Scorer] | None = None


def _score(sent, denominator: float, key: int):
    """Per text what the frequent words give, and its rarer words with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        global _scorer
        if _scorer is None or _scorer[0] != key:
            _scorer = (key, Scorer(*sent.value))
        scorer = _scorer[1]
        v = scorer.vocabulary
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in chunks(batch, "text"):
                offsets, word, tail = _tokens(part.column("text"))
                count, symbol = v.look_up(word, tail)
                s1, s2 = _context(offsets, symbol)
                known, shared = count >= 0, symbol > WORDS
                log_c = np.where(known, np.log10(np.maximum(count, 0) + 0.5), 0.0)
                model = scorer.symbol_scores(s1, s2, symbol).astype(float)
                model += np.where(shared, log_c - np.log10(np.where(shared, v.mass[symbol], 1.0)), 0.0)
                begins = offsets[:-1]
                n = np.diff(offsets)
                rare = np.flatnonzero(~known)
                doc = np.repeat(np.arange(len(n)), n)[rare]
                order = np.lexsort((word[rare], doc))
                h, d = word[rare][order], doc[order]
                first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))) if len(h) else np.zeros(0, int)
                times = np.diff(np.append(first, len(h)))
                at = np.searchsorted(d[first], np.arange(len(n) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(len(n))),
                        part.column("doc_id"),
                        pa.array(n),
                        pa.array(np.add.reduceat((count > 0).astype(np.int64), begins)),
                        pa.array(np.add.reduceat(log_c, begins) - n * denominator),
                        pa.array(np.add.reduceat(model, begins)),
                        pa.ListArray.from_arrays(pa.array(at), pa.array(h[first].view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(at), pa.array(times.astype(np.int32))),
                    ],
                    names=["row", "doc_id", "n_tokens", "n_known", "base_score", "score", "rare", "times"],
                )
                row += len(n)

    return run


_SCORED = (
    "row bigint, doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double, "
    "rare array<bigint>, times array<int>"
)


def score_texts(docs: DataFrame, training: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``.

    ``training`` has the texts to learn from. ``base_score`` is the smoothed unigram log10
    probability, ``score`` the model's; n_known counts tokens that training texts have. A
    null or empty text is one end. Repeated rows and ids give a row each. Without training
    texts every token is unknown. Other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    training = training.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    counts = stage(count_words(training), "counts")
    vocabulary = build_vocabulary(counts)
    flat = Parameters.start(vocabulary.unigram()).flat
    place = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(WARM))
    flat = train_round(training.where(place == 0), vocabulary, flat, seed=100)
    flat = train_round(training.where(place != 0), vocabulary, flat, seed=10_000)

    denominator = float(np.log10(vocabulary.tokens + 0.5 * (vocabulary.types + 1)))
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, flat))
    key = hash(flat.tobytes())
    found = stage(docs.mapInArrow(_score(sent, denominator, key), _SCORED), "scored")
    rare = found.select("row", F.explode(F.arrays_zip("rare", "times")).alias("z")).select(
        "row", F.col("z.rare").alias("h"), F.col("z.times").alias("times")
    )
    seldom = counts.where(F.col("c") < vocabulary.known_from).select("h", "c")
    c = F.coalesce("c", F.lit(0))
    sums = (
        rare.join(seldom, "h", "left")
        .groupBy(F.col("row").alias("of"))
        .agg(
            F.sum(F.col("times") * F.log10(c + 0.5)).alias("more"),
            F.sum(F.when(c > 0, F.col("times")).otherwise(0)).cast("bigint").alias("seen"),
        )
    )
    more = F.coalesce("more", F.lit(0.0))
    return found.join(sums, F.col("row") == F.col("of"), "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )


def held_out(id):
    """Rows kept away from training: crc32 of the id as text leaves 1 when divided by 5."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 5 == 1, F.lit(False))
