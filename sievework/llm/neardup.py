"""Near-duplicate documents by an LSH forest over MinHash signatures.

A text is the set of its word shingles. Texts with equal sets form a class, and one
signature stands for the class. The forest keeps several orders of the signatures;
classes that share a long prefix in some order are candidates:

1. In each order, sorted over all tasks, the neighbours with the longest common
   prefix are compared. The nearest few of every class are confirmed on the full sets,
   then all neighbours that are still in different components, and what is linked is
   contracted to components. A large group of near copies is one component then.
2. In each order, regions (classes with three common values) that still hold more than
   one component are searched for pairs across components. Where few classes lie outside
   the largest component, each is compared with the rest by its sketch: four bits for each
   MinHash value, whose limit loses ten times fewer pairs at the threshold than the orders
   do. A region with more than ``DIRECT`` such classes is searched by differences.

Differences. In a dense region many pairs lie just below the threshold, where neither deeper
prefixes nor sketches tell them from links. There every set A goes as its difference d(A) from
one pivot set P. Sets A and B that are linked differ in at most D = (1 - t) / (1 + t) * (|A| + |B|)
shingles, so d(A) and d(B) share at least s = (|d(A)| + |d(B)| - D) / 2 of theirs. If that is 0 or
less, both are linked with P itself; else, with differences sorted from their rarest shingle
on, they share one among the first |d(A)| - s + 1 and |d(B)| - s + 1. So an equi-join on the rare
shingles of differences finds all links, and what a whole group has in common is in none.
Any order that is the same for all sets serves. Shingles are counted at a bounded number of
places by their hashes, so each set is sorted on its own and only its first shingles move on.
No link is lost in this step. Every link is confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scale import discard, stage
from .graph import components
from .hashing import bound_batches, chunks, mix, word_hashes

TREES = 16
SHARED = 3
DEPTH = 8
FUNCTIONS = TREES * DEPTH
DIRECT = 32
MAP_BITS = 1 << 27
NEAREST = 4
WINDOW = 16
# Items before an item that tell whether a pair has met at an earlier one.
BEFORE = 8
# Places at which shingles of differences are counted, two bytes each.
PLACES = 1 << 21
# Places of one row of counts.
STRETCH = 1 << 17
PART_BYTES = 1 << 20
SKETCH = [f"s{j}" for j in range(FUNCTIONS // 16)]
NIBBLES = 0x1111111111111111

_rng = np.random.default_rng(6)
_XOR = _rng.integers(0, 1 << 32, FUNCTIONS, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 32, FUNCTIONS, dtype=np.uint32) | np.uint32(1)
_PLACE = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)

_SIGNED = "doc_id bigint, n_shingles bigint, cls binary, sig binary, " + ", ".join(f"{s} bigint" for s in SKETCH)

_COUNTED = pa.schema([("part", pa.int32()), ("place", pa.list_(pa.int32())), ("often", pa.list_(pa.int32()))])


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): the sorted distinct shingle hashes of each text.

    A text with fewer words is one shingle of all its words; without words, none.
    """
    at, word = word_hashes(column)
    if len(word) >= words:
        rolled = np.zeros(len(word) - words + 1, np.uint64)
        for j in range(words):
            rolled += word[j : len(rolled) + j] * _PLACE[j]
        rolled = mix(rolled)
    else:
        rolled = np.zeros(0, np.uint64)
    sets = []
    for lo, hi in zip(at[:-1], at[1:]):
        if hi - lo >= words:
            sets.append(np.unique(rolled[lo : hi - words + 1]))
        elif hi > lo:
            whole = (word[lo:hi] * _PLACE[: hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)
            sets.append(mix(np.array([whole], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    offsets = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=offsets[1:])
    return offsets, np.concatenate(sets) if sets else np.zeros(0, np.uint64)


def set_keys(offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """16 bytes that stand for each set, as a column of type V16."""
    sums = np.zeros((len(offsets) - 1, 2), np.uint64)
    for j, seed in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mix(hashes ^ np.uint64(seed)), out=total[1:])
        sums[:, j] = total[offsets[1:]] - total[offsets[:-1]]
    return sums.view("V16").ravel()


def _fixed(values: np.ndarray, width: int, keep: np.ndarray | None = None) -> pa.Array:
    """Rows of a 2-D or void array as a binary column; null where not kept."""
    raw = pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(width), len(values), [None, pa.py_buffer(np.ascontiguousarray(values))]
    ).cast(pa.binary())
    return raw if keep is None else pa.compute.if_else(pa.array(keep), raw, pa.scalar(None, pa.binary()))


def signatures(offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """MinHash values, one row per set that is not empty."""
    sizes = np.diff(offsets)
    begins = offsets[:-1][sizes > 0]
    out = np.empty((len(begins), FUNCTIONS), np.uint32)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    for j in range(FUNCTIONS):
        out[:, j] = np.minimum.reduceat((x ^ _XOR[j]) * _MUL[j], begins) if len(begins) else 0
    return out


def _sketch(sig: np.ndarray) -> np.ndarray:
    """Four bits of each MinHash value, as 64-bit words."""
    bits = (sig & 15).astype(np.uint8)
    return (bits[:, 0::2] | bits[:, 1::2] << 4).view(np.int64).reshape(len(sig), len(SKETCH))


def sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", PART_BYTES):
                offsets, hashes = shingle_sets(part.column("text"), words)
                filled = np.diff(offsets) > 0
                some = signatures(offsets, hashes)
                sig = np.zeros((part.num_rows, FUNCTIONS), np.uint32)
                sig[filled] = some
                sketch = _sketch(sig)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.diff(offsets)),
                        _fixed(set_keys(offsets, hashes), 16, filled),
                        _fixed(sig.astype(">u4"), 4 * FUNCTIONS, filled),
                        *[pa.array(np.ascontiguousarray(sketch[:, j])) for j in range(len(SKETCH))],
                    ],
                    names=["doc_id", "n_shingles", "cls", "sig", *SKETCH],
                )

    return run


def sketch_limit(threshold: float) -> int:
    """Most differing sketch values of a candidate.

    A pair at the threshold differs in more with a tenth of the chance, by the exact
    binomial, with which the orders miss it.
    """
    differ = (1 - threshold) * 15 / 16
    enough = (1 - threshold ** SHARED) ** TREES / 10
    limit, beyond = FUNCTIONS, 0.0
    while limit > 0:
        beyond += comb(FUNCTIONS, limit) * differ**limit * (1 - differ) ** (FUNCTIONS - limit)
        if beyond > enough:
            break
        limit -= 1
    return limit


def in_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, comp, n, region) of each class in each order; ``region`` hashes the order and its first values."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), ">u4").reshape(-1, FUNCTIONS)
            region = np.empty((TREES, len(sig)), np.uint64)
            for j in range(TREES):
                h = mix(np.full(len(sig), j + 1, np.uint64))
                for f in range(j * DEPTH, j * DEPTH + SHARED):
                    h = mix(h ^ sig[:, f].astype(np.uint64))
                region[j] = h
            again = pa.array(np.tile(np.arange(len(sig)), TREES))
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c).take(again) for c in ("cls", "comp", "n")], pa.array(region.view(np.int64).ravel())],
                names=["cls", "comp", "n", "region"],
            )


def neighbours(limit: int):
    """Pairs next to each other in one order, with a common prefix and similar sketches.

    Besides the row after it, each row is paired with the most similar of the WINDOW rows
    after it. In a large group of near copies many rows have links to few others only, and
    a link found here keeps a row out of the search of its whole regions.
    """
    width = 1 + 4 * SHARED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = b"".join(k[:width] for k in batch.column("key").to_pylist())
            prefix = np.frombuffer(keys, np.uint8).reshape(-1, width)
            cls = batch.column("cls").to_pylist()
            sk = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in SKETCH], axis=1)
            new = len(cls)
            if held is not None:
                prefix, cls, sk = np.concatenate([held[0], prefix]), held[1] + cls, np.concatenate([held[2], sk])
            n = len(cls)
            # Each pair once: with the batch in which its later row is.
            next_one = np.full(n, limit + 1)
            best, place = np.full(n, limit + 1), np.zeros(n, np.int64)
            for lag in range(1, min(WINDOW, n - 1) + 1):
                x = sk[lag:] ^ sk[:-lag]
                x |= x >> np.uint64(2)
                x |= x >> np.uint64(1)
                apart = np.bitwise_count(x & np.uint64(NIBBLES)).sum(axis=1).astype(np.int64)
                apart[(prefix[lag:] != prefix[:-lag]).any(axis=1)] = limit + 1
                apart[: max(n - new - lag, 0)] = limit + 1
                if lag == 1:
                    next_one[: n - 1] = apart
                    continue
                closer = apart < best[: n - lag]
                best[: n - lag][closer] = apart[closer]
                place[: n - lag][closer] = lag
            pairs = [(cls[i], cls[i + 1], int(next_one[i])) for i in np.flatnonzero(next_one <= limit)]
            pairs += [(cls[i], cls[i + place[i]], int(best[i])) for i in np.flatnonzero(best <= limit)]
            held = (prefix[-WINDOW:], cls[-WINDOW:], sk[-WINDOW:])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([p[0] for p in pairs], pa.binary()),
                    pa.array([p[1] for p in pairs], pa.binary()),
                    pa.array([p[2] for p in pairs], pa.int32()),
                ],
                names=["u", "v", "apart"],
            )

    return run


def confirm(words: int, per_cent: int):
    """Pairs whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("text_u", "text_v"):
                sides.append([])
                one = batch.select([name])
                for part in chunks(one, name, PART_BYTES):
                    offsets, hashes = shingle_sets(part.column(0), words)
                    sides[-1] += [hashes[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
            keep = []
            for i, (a, b) in enumerate(zip(*sides)):
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= per_cent * (len(a) + len(b) - both):
                    keep.append(i)
            yield batch.select(["u", "v"]).take(pa.array(keep, pa.int64()))

    return run


def differences(words: int):
    """The shingles in which the set of ``text_v`` differs from that of ``text_u``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text_v", PART_BYTES):
                pivots = {}
                offsets, hashes = shingle_sets(part.column("text_v"), words)
                found = []
                for i, u in enumerate(part.column("u").to_pylist()):
                    if u not in pivots:
                        pivots = {u: shingle_sets(part.column("text_u").slice(i, 1), words)[1]}
                    found.append(np.setxor1d(pivots[u], hashes[offsets[i] : offsets[i + 1]], assume_unique=True))
                at = np.zeros(len(found) + 1, np.int64)
                np.cumsum([len(f) for f in found], out=at[1:])
                items = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("u"),
                        part.column("v"),
                        pa.array(np.diff(at)),
                        pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(items)),
                    ],
                    names=["pivot", "cls", "m", "items"],
                )

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per task and STRETCH of places that has any: the places and their counts."""
    counts = np.zeros(PLACES, np.int64)
    for batch in batches:
        lists = batch.column("items")
        at, items = lists.offsets.to_numpy(), lists.values.to_numpy()[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
        salts = np.repeat(batch.column("salt").to_numpy(), np.diff(at))
        counts += np.bincount((items ^ salts) & (PLACES - 1), minlength=PLACES)
    for part in range(0, PLACES, STRETCH):
        yield from _stretch(part, counts[part : part + STRETCH])


def _stretch(part: int, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    place = np.flatnonzero(counts)
    if len(place):
        yield pa.RecordBatch.from_pydict(
            {"part": [part], "place": [place.astype(np.int32)], "often": [np.minimum(counts[place], 65_535).astype(np.int32)]},
            _COUNTED,
        )


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tasks' counts added up, stretch after stretch as they are sorted; the places of two or more."""
    held, counts = None, np.zeros(STRETCH, np.int64)
    for batch in batches:
        for part, place, often in zip(batch.column("part").to_pylist(), batch.column("place"), batch.column("often")):
            if part != held:
                if held is not None:
                    yield from _stretch(held, np.where(counts > 1, counts, 0))
                held, counts = part, np.zeros(STRETCH, np.int64)
            counts[place.values.to_numpy()] += often.values.to_numpy()
    if held is not None:
        yield from _stretch(held, np.where(counts > 1, counts, 0))


def _often(sets: DataFrame) -> np.ndarray:
    """How many shingles of the differences fall on each of PLACES places (65,535: that or more).

    The map has 4 MB however many sets there are. A shingle alone on its place is in one set
    only; others that meet there just come later in the order than they need. Each task counts
    its own sets, so shingles are no rows; a task that adds up holds one stretch.
    """
    kind = "part int, place array<int>, often array<int>"
    own = sets.select("salt", "items").mapInArrow(_counted, kind)
    dealt = own.repartition(PLACES // STRETCH, "part").sortWithinPartitions("part")
    seen = np.zeros(PLACES, np.uint16)
    for row in dealt.mapInArrow(_added, kind).toArrow().to_batches():
        for part, place, often in zip(row.column("part").to_pylist(), row.column("place"), row.column("often")):
            seen[part + place.values.to_numpy()] = often.values.to_numpy()
    return seen


def first_items(seen: np.ndarray, per_cent: int):
    """The shingles at the beginning of each difference, rarest first, that other sets may share.

    Shingles of one set only come first and link nothing: they count as places but make no row.
    ``lately`` holds the BEFORE shared ones before. Sets that can be linked with one of n shingles
    have at most 100 n / per_cent, so the two differ in at most (100 - per_cent) * n / per_cent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("items")
            at, items = lists.offsets.to_numpy(), lists.values.to_numpy()
            salts, sizes = batch.column("salt").to_numpy(), batch.column("n").to_numpy()
            row, item, place, lately = [], [], [], []
            for i in range(batch.num_rows):
                own = items[at[i] : at[i + 1]]
                often = seen[(own ^ salts[i]) & (PLACES - 1)]
                order = np.lexsort((own, often))
                shared = np.flatnonzero(often[order] > 1)
                shared = shared[shared <= (100 - per_cent) * int(sizes[i]) // per_cent]
                found = own[order[shared]].tolist()
                row += [i] * len(found)
                item += found
                place += shared.tolist()
                lately += [found[max(k - BEFORE, 0) : k] for k in range(len(found))]
            taken = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("pivot").take(taken),
                    pa.array(item, pa.int64()),
                    *[batch.column(c).take(taken) for c in ("cls", "comp", "n", "m")],
                    pa.array(place, pa.int64()),
                    pa.array(lately, pa.list_(pa.int64())),
                ],
                names=["pivot", "item", "cls", "comp", "n", "m", "place", "lately"],
            )

    return run


def _near_ids(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents whose id may be among ``wanted.rep``, by a bit map of id hashes.

    It keeps the other texts out of the shuffle of the join that follows. The map has
    MAP_BITS bits at most (16 MB), so it can always be sent to every task.
    """
    n = wanted.count()
    bits = min(MAP_BITS, 1 << max(15, (16 * n).bit_length()))

    def place(id: str) -> Column:
        return F.pmod(F.xxhash64(id), F.lit(bits))

    held = wanted.groupBy(F.bitmap_bucket_number(place("rep")).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place("rep"))).alias("held")
    )
    rows = docs.withColumns(
        {"bucket": F.bitmap_bucket_number(place("doc_id")), "bit": F.bitmap_bit_position(place("doc_id"))}
    )
    byte = F.conv(F.hex(F.substring("held", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.join(F.broadcast(held), "bucket")
    return found.where(F.call_function("bit_get", byte, (F.col("bit") % 8).cast("int")) == 1).select("doc_id", "text")


def _texts(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """(cls, text) of the classes in ``pairs``: the text of the class's first document."""
    ends = pairs.select(F.col("u").alias("cls")).unionByName(pairs.select(F.col("v").alias("cls"))).distinct()
    wanted = stage(ends.join(nodes.select("cls", "rep"), "cls"), "wanted")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", PART_BYTES):
                keys = _fixed(set_keys(*shingle_sets(part.column("text"), words)), 16)
                yield part.select(["cls", "text"]).filter(pa.compute.equal(keys, part.column("cls")))

    near = _near_ids(docs, wanted)
    found = near.join(wanted, near.doc_id.eqNullSafe(wanted.rep)).select("cls", "text")
    return found.mapInArrow(own, "cls binary, text string").dropDuplicates(["cls"])


def _with_texts(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    texts = stage(_texts(docs, nodes, pairs, words), "texts")
    left = texts.select(F.col("cls").alias("u"), F.col("text").alias("text_u"))
    right = texts.select(F.col("cls").alias("v"), F.col("text").alias("text_v"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "text_u", "text_v")


def _confirmed(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int, per_cent: int) -> DataFrame:
    rows = _with_texts(docs, nodes, pairs, words)
    return stage(rows.mapInArrow(confirm(words, per_cent), "u binary, v binary"), "links")


def _apart(a: str, b: str) -> Column:
    """Differing sketch values of two rows."""
    total = F.lit(0)
    for c in SKETCH:
        x = F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        total = total + F.bit_count(x.bitwiseAND(F.lit(NIBBLES)))
    return total


def _in_orders(nodes: DataFrame, *carry: str) -> DataFrame:
    """One row per class and order, ``key`` the order's number and signature part."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    rows = nodes.select("cls", "sig", *carry, tree)
    part = F.substring("sig", F.col("tree") * (4 * DEPTH) + 1, F.lit(4 * DEPTH))
    number = F.unhex(F.lpad(F.hex("tree"), 2, "0"))
    return rows.select("cls", *carry, F.concat(number, part).alias("key"))


def _edges(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("node").alias("u"), F.col("root").alias("v"))


def _between(pairs: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components."""
    side = nodes.join(roots, F.col("cls") == F.col("node"), "left").select(
        "cls", F.xxhash64(F.coalesce("root", "cls")).alias("comp")
    )
    left = side.select(F.col("cls").alias("u"), F.col("comp").alias("cu"))
    right = side.select(F.col("cls").alias("v"), F.col("comp").alias("cv"))
    both = pairs.select("u", "v").join(left, "u").join(right, "v")
    return both.where(F.col("cu") != F.col("cv")).select("u", "v")


def _across(docs: DataFrame, nodes: DataFrame, words: int, threshold: float) -> DataFrame:
    """Candidate pairs of different components that share a region.

    ``nodes`` has cls, rep, n, sig, the sketch, ``root`` and ``comp``, the component's hash.
    """
    per_cent = round(100 * threshold)
    keyed = nodes.select("cls", "comp", "n", "sig").mapInArrow(in_regions, "cls binary, comp bigint, n int, region bigint")
    regions = (
        keyed.groupBy("region")
        .agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
        .where(F.col("low") != F.col("high"))
        .select("region")
    )
    mixed = stage(keyed.join(regions, "region"), "regions")
    sizes = mixed.groupBy("region", "comp").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("n"))
    outside = F.sum("size") - F.max("size")
    judged = stage(
        sizes.groupBy("region").agg(
            F.max(F.struct("size", "comp"))["comp"].alias("main"),
            F.percentile_approx("n", 0.5).alias("middle"),
            (outside > DIRECT).alias("dense"),
        ),
        "judged",
    )
    few = mixed.join(judged.where(~F.col("dense")).select("region", "main"), "region")
    pairs = _region_pairs(few, nodes, sketch_limit(threshold), per_cent)
    dense = judged.where("dense")
    if dense.isEmpty():
        return pairs
    # The pivot is of the largest component; of several, one of middle size.
    chosen = F.max(F.struct("size", (F.col("n") == F.col("middle")).alias("fits"), "comp"))["comp"]
    pivots = sizes.join(dense, "region").groupBy("region").agg(chosen.alias("at"))
    roots = nodes.where(F.col("cls") == F.col("root")).select(F.col("comp").alias("at"), F.col("cls").alias("pivot"))
    crowded = (
        mixed.join(pivots.join(roots, "at"), "region")
        .where(F.col("pivot") != F.col("cls"))
        .select(F.col("pivot").alias("u"), F.col("cls").alias("v"))
        .distinct()
    )
    return pairs.unionByName(_by_differences(docs, nodes, stage(crowded, "crowded"), words, per_cent))


def _by_differences(docs: DataFrame, nodes: DataFrame, crowded: DataFrame, words: int, per_cent: int) -> DataFrame:
    """Candidate pairs among the classes ``v`` of each pivot ``u``, and of these with their pivot.

    Every linked pair of different components is among them or follows from them.
    """
    rows = _with_texts(docs, nodes, crowded, words).mapInArrow(
        differences(words), "pivot binary, cls binary, m bigint, items array<bigint>"
    )
    apart, joined = 100 - per_cent, 100 + per_cent
    side = nodes.select("cls", "n", "comp")
    of_pivot = nodes.select(F.col("cls").alias("pivot"), F.col("n").alias("n_pivot"), F.col("comp").alias("comp_pivot"))
    sets = stage(rows, "differences").join(side, "cls").join(of_pivot, "pivot")
    sets = stage(sets.withColumn("salt", F.xxhash64("pivot")), "sets")
    linked = (F.col("comp") != F.col("comp_pivot")) & (joined * F.col("m") <= apart * (F.col("n") + F.col("n_pivot")))
    with_pivot = sets.where(linked).select(F.least("pivot", "cls").alias("u"), F.greatest("pivot", "cls").alias("v"))

    seen = _often(sets)
    columns = "pivot binary, item bigint, cls binary, comp bigint, n int, m bigint, place bigint, lately array<bigint>"
    beginnings = sets.select("pivot", "cls", "comp", "n", "m", "salt", "items").mapInArrow(first_items(seen, per_cent), columns)
    looked = stage(beginnings, "placed")
    # The larger difference (a) looks up the smaller (b).
    a = looked.alias("a")
    b = looked.where(2 * per_cent * F.col("place") <= apart * F.col("n")).alias("b")

    def early(x: str) -> Column:
        rest = 2 * (F.col(f"{x}.m") - F.col(f"{x}.place")) - F.col("a.m") - F.col("b.m")
        return joined * rest + apart * (F.col("a.n") + F.col("b.n")) >= 0

    larger = (F.col("a.m") > F.col("b.m")) | ((F.col("a.m") == F.col("b.m")) & (F.col("a.cls") < F.col("b.cls")))
    condition = (
        (F.col("a.pivot") == F.col("b.pivot"))
        & (F.col("a.item") == F.col("b.item"))
        & (F.col("a.comp") != F.col("b.comp"))
        & (100 * F.least("a.n", "b.n") >= per_cent * F.greatest("a.n", "b.n"))
        & larger
        & early("a")
        & early("b")
        # All sets have their shingles in one order, so a pair that shares one of those just
        # before has met there under the same conditions: the first it shares is never left out.
        & ~F.arrays_overlap("a.lately", "b.lately")
    )
    found = a.join(b, condition).select(F.least("a.cls", "b.cls").alias("u"), F.greatest("a.cls", "b.cls").alias("v"))
    return with_pivot.unionByName(found)


def _region_pairs(rows: DataFrame, nodes: DataFrame, limit: int, per_cent: int) -> DataFrame:
    """Pairs across components within regions, each smaller side against the rest.

    Sets whose sizes differ by more than the threshold allows can't be similar.
    """
    sketch = nodes.select("cls", "n", *SKETCH)
    full = rows.select("region", "cls", "comp", "main").join(sketch, "cls")
    minor = full.where(F.col("comp") != F.col("main")).alias("a")
    other = full.alias("b")
    once = (F.col("b.comp") == F.col("b.main")) | (F.col("a.cls") < F.col("b.cls"))
    condition = (
        (F.col("a.region") == F.col("b.region"))
        & (F.col("a.comp") != F.col("b.comp"))
        & once
        & (100 * F.least("a.n", "b.n") >= per_cent * F.greatest("a.n", "b.n"))
        & (_apart("a", "b") <= limit)
    )
    return minor.join(other, condition).select(
        F.least("a.cls", "b.cls").alias("u"), F.greatest("a.cls", "b.cls").alias("v")
    )


def near_duplicates(
    docs: DataFrame, words: int = 5, threshold: float = 0.8, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents whose shingle sets have a Jaccard similarity of at least ``threshold``
    (in whole per cent) are linked; ``component_id`` is the smallest id reachable and
    ``kept`` marks the document that has it. Null, empty and blank texts have no
    shingles and are linked with nothing. Rows that repeat an id count as documents of
    their own with that id; a null id is below none and is kept only where its whole
    group has no other id (``component_id`` is null then). Other columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    per_cent = round(100 * threshold)
    limit = sketch_limit(threshold)
    docs = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    signed = stage(docs.mapInArrow(sign(words), _SIGNED), "signed")
    nodes = stage(
        signed.where(F.col("n_shingles") > 0)
        .groupBy("cls")
        .agg(
            F.min("doc_id").alias("rep"),
            F.first("n_shingles").cast("int").alias("n"),
            *[F.first(c).alias(c) for c in ("sig", *SKETCH)],
        ),
        "nodes",
    )

    # The signatures, which make up most of these tables, are kept once.
    ids = stage(signed.select("doc_id", "n_shingles", "cls"), "ids")
    discard(signed)

    order = _in_orders(nodes, *SKETCH).repartitionByRange("key", "cls")
    near = stage(
        order.sortWithinPartitions("key", "cls")
        .mapInArrow(neighbours(limit), "u binary, v binary, apart int")
        .groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .agg(F.min("apart").alias("apart")),
        "neighbours",
    )
    back = near.select(F.col("v").alias("u"), F.col("u").alias("v"), "apart")
    by_place = Window.partitionBy("u").orderBy("apart", "v")
    nearest = near.unionByName(back).withColumn("place", F.row_number().over(by_place)).where(F.col("place") <= NEAREST)
    first = nearest.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    tight = components(_confirmed(docs, nodes, stage(first, "nearest"), words, per_cent))
    others = stage(_between(near, nodes, tight), "others")
    more = _confirmed(docs, nodes, others, words, per_cent)
    tight = components(_edges(tight).unionByName(more))

    root = F.coalesce("root", "cls")
    grouped = nodes.join(tight, F.col("cls") == F.col("node"), "left").select(
        *nodes.columns, root.alias("root"), F.xxhash64(root).alias("comp")
    )
    grouped = stage(grouped, "grouped")
    discard(nodes)
    rest = stage(_across(docs, grouped, words, threshold).distinct(), "pairs")
    more = _confirmed(docs, grouped, rest, words, per_cent)
    roots = stage(components(_edges(tight).unionByName(more)), "roots")

    owned = grouped.select("cls", "rep").join(roots, F.col("cls") == F.col("node"), "left").select(
        "cls", "rep", F.coalesce("root", "cls").alias("root")
    )
    labels = owned.groupBy("root").agg(F.min("rep").alias("label"))
    label = owned.join(labels, "root").select("cls", "label", F.lit(True).alias("known"))
    out = ids.join(label, "cls", "left")
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("known"), F.col("label")).otherwise(F.col("doc_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """One document of each group of :func:`near_duplicates`, with all its columns.

    Of rows that repeat the kept id, the one with the smallest hash of its text stays; in
    a group without any id, likewise one per id null and text.
    """
    # The sides go by alias, as the documents may have columns of any name.
    keep = near_duplicates(docs, words, threshold).where("kept").select("doc_id").distinct()
    same = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id"))
    kept = docs.alias("d").join(keep.alias("k"), same, "left_semi").select("d.*")
    repeated = stage(
        kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min(F.xxhash64("text")).alias("least")).where("rows > 1"),
        "repeated",
    )
    if repeated.isEmpty():
        return kept
    once = kept.alias("d").join(repeated.alias("k"), same, "left_anti").select("d.*")
    smallest = same & (F.xxhash64(F.col("d.text")) == F.col("k.least"))
    first = kept.alias("d").join(repeated.alias("k"), smallest).select("d.*")
    return once.unionByName(first.dropDuplicates(["doc_id"]))
