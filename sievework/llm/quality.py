"""Quality classifier: hashed word n-grams, logistic regression, FTRL updates.

Features of a text are its words, its word pairs, the shapes of its words (letters,
capitals, digits and signs as classes, runs as one) and pairs of shapes, where a shape
also tells whether the word repeats the one before. All are hashed into one space of
2^18 places. Counts are damped by a logarithm, and each of the two kinds (words,
shapes) is scaled to length one, so long and short texts compare.

The model is fitted on a bounded sample of labelled documents: the ``max_rows`` with the
smallest hash of their id. The whole text of a sampled document is used. Weights are one
vector of 2^18 numbers, so sending them to every task has a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import bound_batches, chunks, mix, word_hashes

BITS = 18
SPACE = 1 << BITS
MAX_ROWS = 4_000
SCORES = "doc_id bigint, score double"
_A, _B, _C = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def _rows(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts)), counts)


def _pairs(values: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of neighbours within one row, and their rows."""
    same = row[1:] == row[:-1]
    return mix(values[:-1][same] * _A + values[1:][same] * _B), row[1:][same]


def _scaled(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, value): damped counts, each row of length one."""
    place = (mix(hashes) >> np.uint64(64 - BITS)).astype(np.int64)
    key, count = np.unique(row * SPACE + place, return_counts=True)
    row, place = key >> BITS, key & (SPACE - 1)
    value = np.log1p(count)
    length = np.sqrt(np.bincount(row, value * value, n))
    return row, place, value / np.maximum(length[row], 1e-12)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, places, values) of each text, in order of rows."""
    at, word, shape = word_hashes(column, shapes=True)
    n = len(at) - 1
    row = _rows(np.diff(at))
    repeats = np.zeros(len(word), bool)
    repeats[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    shape = mix(shape.astype(np.uint64) ^ _C) + repeats.astype(np.uint64)
    words = [(word, row), _pairs(word, row)]
    shapes = [(shape, row), _pairs(shape, row)]
    parts = []
    for kind in (words, shapes):
        hashes = np.concatenate([h for h, _ in kind])
        parts.append(_scaled(hashes, np.concatenate([r for _, r in kind]), n))
    row, place, value = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.argsort(row, kind="stable")
    offsets = np.searchsorted(row[order], np.arange(n + 1))
    return offsets, place[order], value[order]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        """The probability of label 1 of each text; texts without words get the bias."""
        offsets, place, value = features(column)
        total = np.zeros(len(place) + 1)
        np.cumsum(self.weights[place] * value, out=total[1:])
        z = total[offsets[1:]] - total[offsets[:-1]] + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray, int]],
    epochs: int = 4,
    alpha: float = 1.5,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.5,
    seed: int = 1,
) -> Model:
    """Follow-the-regularised-leader (proximal) over (places, values, label) rows.

    Both labels weigh the same in total. Without rows of both labels, the model says
    the share of label 1 with one row of either label added.
    """
    ones = sum(y for _, _, y in rows)
    zeros = len(rows) - ones
    prior = float(np.log((ones + 1) / (zeros + 1)))
    z, n = np.zeros(SPACE + 1), np.zeros(SPACE + 1)

    def solve(at):
        lead = np.abs(z[at]) - np.where(at == SPACE, 0, l1)
        slope = (beta + np.sqrt(n[at])) / alpha + np.where(at == SPACE, 0, l2)
        return np.where(lead > 0, -np.sign(z[at]) * lead / slope, 0.0)

    rng = np.random.default_rng(seed)
    if ones and zeros:
        weigh = {1: len(rows) / (2 * ones), 0: len(rows) / (2 * zeros)}
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                place, value, y = rows[i]
                at, x = np.append(place, SPACE), np.append(value, 1.0)
                w = solve(at)
                p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
                g = (p - y) * weigh[y] * x
                sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
                z[at] += g - sigma * w
                n[at] += g * g
    w = solve(np.arange(SPACE + 1))
    return Model(w[:SPACE], float(w[SPACE]) if ones and zeros else prior)


def _digests(offsets: np.ndarray, place: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A number for each row's features, which fixes the order of training."""
    total = np.zeros(len(place) + 1, np.uint64)
    np.cumsum(mix(place.astype(np.uint64) * _A + (value * 1e6).astype(np.uint64)), out=total[1:])
    return (total[offsets[1:]] - total[offsets[:-1]]).view(np.int64)


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            offsets, place, value = features(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("label"),
                    pa.array(_digests(offsets, place, value)),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(place.astype(np.int32))),
                    pa.ListArray.from_arrays(
                        pa.array(offsets.astype(np.int32)), pa.array(value.astype(np.float32))
                    ),
                ],
                names=["label", "digest", "place", "value"],
            )


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all rows, as one row."""
    held = [batch for batch in batches if batch.num_rows]
    if not held:
        return
    found = pa.Table.from_batches(held).combine_chunks()
    order = np.lexsort((found.column("digest").to_numpy(), found.column("label").to_numpy()))
    label = found.column("label").to_numpy()
    place, value = (found.column(c).chunk(0) for c in ("place", "value"))
    model = fit_ftrl([(place[i].values.to_numpy(), value[i].values.to_numpy(), int(label[i])) for i in order.tolist()])
    yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()]), pa.array([model.bias])], names=["weights", "bias"])


def train(labelled: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fit on at most ``max_rows`` rows of (doc_id, text, label 0/1).

    Rows without a label or id are left out. The sample is the rows with the smallest
    hash of the id, so it does not depend on order, source or key. One task learns from
    these rows; the driver gets the model alone.
    """
    bound_batches(labelled.sparkSession)
    known = labelled.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    chosen = known.select("doc_id", "label", F.xxhash64("doc_id").alias("h")).distinct()
    chosen = chosen.orderBy("h", "doc_id", "label").limit(max_rows).select("doc_id", "label")
    texts = known.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "text")
    sparse = texts.mapInArrow(_sparse, "label int, digest bigint, place array<int>, value array<float>")
    fitted = sparse.repartition(1).mapInArrow(_fit, "weights binary, bias double").toArrow()
    if fitted.num_rows == 0:
        return fit_ftrl([])
    return Model(np.frombuffer(fitted.column("weights")[0].as_py(), np.float64), fitted.column("bias")[0].as_py())


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row, whole texts; null and empty texts get the bias."""
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                scores = sent.value.scores(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, SCORES)


def held_out(id: Column) -> Column:
    """Rows kept away from training: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_on_labels(docs: DataFrame, labels: DataFrame, column: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Fit on the documents that ``labels`` marks, without the held-out rows.

    Both tables may repeat ids; equal labelled rows count once.
    """
    marks = labels.select("doc_id", F.col(column).cast("int").alias("label")).where(~held_out(F.col("doc_id")))
    marks = marks.where(F.col("label").isin(0, 1)).distinct()
    small = marks.select("doc_id", "label", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id", "label")
    chosen = small.limit(max_rows).select(F.col("doc_id").alias("marked"), "label")
    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    return train(rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("marked")).select("doc_id", "text", "label"), max_rows)


def keep_good(docs: DataFrame, model: Model, reject_below: float) -> DataFrame:
    """Documents that score at least ``reject_below``, with all their columns.

    Each row is judged by its own text, so repeated or missing ids don't matter.
    """
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                yield part.filter(pa.array(sent.value.scores(part.column("text")) >= reject_below))

    return docs.mapInArrow(run, docs.schema)
