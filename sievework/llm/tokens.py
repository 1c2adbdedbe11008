"""Token ids of documents as ORC files, and reading them back.

Documents are range partitioned by id, so that file i holds smaller ids than file i + 1,
and each task writes one file in id order. ORC stores the ids as run-length encoded
integers, keeps row indexes with the smallest and largest document id of each 1,000
rows, and Bloom filters of the document ids; readers split a file by its stripes and
skip row groups and stripes by these.

Per document the file has its place in the file (``file_start``: ids before it there).
A small table of files with their token counts gives the place in the whole corpus.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .hashing import bound_batches, chunks

END_ID = 2
CACHE_PIECES = 300_000
# The pieces of so much text are held as Python strings at once.
PART_BYTES = 1 << 20
OPTIONS = {
    "compression": "zstd",
    "orc.stripe.size": str(16 << 20),
    "orc.row.index.stride": "1000",
    "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
ENCODED = "file int, doc_id bigint, file_start bigint, n_tokens bigint, ids array<int>"

# Byte-level pre-tokenisers never join tokens over these borders, so pieces may be
# encoded one by one. A word goes without the signs behind it, which would make many
# pieces of one word, unless the next sign is an apostrophe or may be of the word.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏЀ-ҁҊ-ӿ"
PIECE = re.compile(rf" ?[{LETTERS}]++(?=[\x00-&(-\x7f]|\Z)| ?\S+|\s+(?!\S)|\s+")
# One word to such pre-tokenisers, whatever stands around it.
WORD = re.compile(rf" ?[{LETTERS}]++")
# White space to Python only; texts with these are encoded whole.
ODD_SPACE = re.compile("[\x1c-\x1f]")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_signs() -> dict[int, str]:
    """The sign that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


BYTE_SIGNS = _byte_signs()


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Pieces(dict):
    """The ids of pieces; a piece that is not there is encoded, and kept while there is room."""

    def __init__(self, encode: Callable[[str], bytes], room: int):
        self.encode, self.room = encode, room

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(self) < self.room:
            self[piece] = ids
        return ids


class Encoder:
    """A byte-level BPE tokenizer with a bounded memory of pieces it has encoded.

    Strings of special tokens in a text are ordinary text. A new word goes straight to the
    tokenizer's merges where what comes before them (normaliser, added tokens, cuts) leaves
    words as they are; any other piece takes the whole way.
    """

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model if self._plain_words() else None
        self.known = Pieces(self._encode_piece, cache_pieces)

    def _plain_words(self) -> bool:
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel

        tokenizer, cuts = self.tokenizer, self.tokenizer.pre_tokenizer
        return (
            tokenizer.normalizer is None
            and isinstance(cuts, ByteLevel)
            and cuts.use_regex
            and not cuts.add_prefix_space
            and isinstance(tokenizer.model, BPE)
            and tokenizer.truncation is None
            and tokenizer.padding is None
            and all(token.special for token in tokenizer.get_added_tokens_decoder().values())
        )

    def _ids(self, text: str) -> bytes:
        return packed(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def _encode_piece(self, piece: str) -> bytes:
        if self.model is None or not WORD.fullmatch(piece):
            return self._ids(piece)
        signs = piece.encode().decode("latin-1").translate(BYTE_SIGNS)
        return packed([token.id for token in self.model.tokenize(signs)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        piece = self.known.__getitem__
        return [self._ids(t) if ODD_SPACE.search(t) else b"".join(map(piece, PIECE.findall(t))) for t in texts]


# One encoder for each vocabulary and Python worker, which serves many tasks.
_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _encode(path: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        file, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in chunks(batch, "text", PART_BYTES):
                found = [ids + end for ids in encoder.encode([t or "" for t in part.column("text").to_pylist()])]
                counts = np.array([len(ids) // 4 for ids in found], np.int64)
                offsets = np.zeros(len(found) + 1, np.int64)
                np.cumsum(counts, out=offsets[1:])
                ids = pa.ListArray.from_arrays(
                    pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(found), np.int32))
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(found), file, np.int32)),
                        part.column("doc_id"),
                        pa.array(offsets[:-1] + start),
                        pa.array(counts),
                        ids,
                    ],
                    names=["file", "doc_id", "file_start", "n_tokens", "ids"],
                )
                start += int(offsets[-1])

    return run


def write_tokens(
    docs: DataFrame,
    path: str,
    vocabulary: str | None = None,
    end_id: int = END_ID,
    id: str = "doc_id",
    text: str = "text",
) -> None:
    """Encode whole texts and write them under ``path`` in ascending id order.

    Every document ends with ``end_id``; null and empty texts have that alone. Null ids
    come first; rows that share an id are in order of a hash of their texts. Other
    columns are ignored.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    # The last key splits rows that agree in id and text; their order doesn't matter.
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange("doc_id", "tie", "row")
    ordered = dealt.sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    encoded = ordered.mapInArrow(_encode(vocabulary or vocabulary_path(), end_id), ENCODED)
    encoded.write.options(**OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids: ``start`` counts the ids of all documents before.

    A condition on doc_id is checked against the row indexes and Bloom filters first.
    """
    schema = ", ".join(ENCODED.split(", "))
    rows = spark.read.schema(schema).orc(path)
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    begin = files.select(F.col("file").alias("of"), F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("begin"))
    return rows.join(begin, F.col("file") == F.col("of")).select(
        "doc_id", (F.col("begin") + F.col("file_start")).alias("start"), "n_tokens", "ids"
    )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        values = np.ascontiguousarray(ids.values.to_numpy()).astype("<u4", copy=False)
        at = ids.offsets.to_numpy()
        sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("doc_id", "start", "n_tokens")] + [pa.array(sums, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what was read back."""
    bound_batches(tokens.sparkSession)
    return tokens.mapInArrow(_digest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
