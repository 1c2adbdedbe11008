"""Conversations as training text, one example for every assistant turn.

A conversation becomes a stream of pieces, one per turn:

    <|im_start|>role
    text<|im_end|>

An example is a prefix of the stream: everything before an assistant's reply is its
context, and the loss mask covers that reply alone. All examples of a conversation are
prefixes of one stream, so they are kept as (target, context_end, reply_end) over pieces
that are written once; :func:`example_texts` spells them out. A conversation of n turns
costs n pieces and not n * n / 2. What is trainable is read through the examples alone.

Control strings inside roles and texts are escaped by one more backslash between ``<``
and ``|``; taking it away again gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scale import stage
from .hashing import bound_batches, chunks

START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"
PIECES = (
    "part int, conv_id bigint, n bigint, begin bigint, piece string, "
    "reply_begin bigint, reply_end bigint"
)
DIGESTS = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
    "formatted_chars bigint, n_examples bigint, example_chars bigint"
)

_OPEN = re.compile(r"<(\\*)\|")
_CLOSED = re.compile(r"<(\\*)\\\|")
_PARTS = re.compile(re.escape(START) + r"([^\n]*)\n(.*)" + re.escape(END) + r"\n", re.S)


def escape(text: str) -> str:
    return _OPEN.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _CLOSED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """Roles stand on one line."""
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def _same(a, b) -> bool:
    return a == b or (a is None and b is None)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, n, at, first = None, 0, 0, True
    for batch in batches:
        for part in chunks(batch, "text"):
            out = []
            for task, conv_id, role, text in zip(*(part.column(c).to_pylist() for c in ("part", "conv_id", "role", "text"))):
                if first or not _same(conv_id, conv):
                    conv, n, at, first = conv_id, 0, 0, False
                head = f"{START}{escape_role(role or '')}\n"
                body = escape(text or "")
                piece = f"{head}{body}{END}\n"
                reply = (at + len(head), at + len(head) + len(body)) if role == ASSISTANT else (None, None)
                out.append((task, conv_id, n, at, piece, *reply))
                n += 1
                at += len(piece)
            columns = zip(*out) if out else [[]] * 7
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types)],
                names=["part", "conv_id", "n", "begin", "piece", "reply_begin", "reply_end"],
            )


def _in_parts(turns: DataFrame) -> DataFrame:
    """The pieces with places counted from where each task's part of a conversation begins."""
    bound_batches(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text")
    rows = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    rows = rows.select(F.spark_partition_id().alias("part"), "conv_id", "role", "text")
    return stage(rows.mapInArrow(_format, PIECES), "chat")


def format_turns(turns: DataFrame) -> DataFrame:
    """Pieces of all conversations: conv_id, n, begin, piece, reply_begin, reply_end.

    ``turns`` has conv_id, turn, role and text; other columns are ignored. Turns are in
    order of ``turn`` (null first), then role and text, so repeated rows and ties have a
    fixed order. Null roles and texts are empty; rows with a null conv_id are one
    conversation. ``begin`` counts code points before the piece.

    Turns are dealt by ranges of (conv_id, turn), so a conversation of very many turns is
    split over tasks. Each task counts from where its part begins; a part that continues
    a conversation is moved by what the tasks before it hold. That is one part a task.
    """
    parts = _in_parts(turns)
    held = parts.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("piece")).alias("chars"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    moves = (
        held.select(
            F.col("conv_id").alias("c"), F.col("part").alias("p"), F.sum("turns").over(before).alias("turns"),
            F.sum("chars").over(before).alias("chars"),
        )
        .where(F.col("turns") > 0)
    )
    own = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))
    moved = {c: F.col(c) + F.coalesce("chars", F.lit(0)) for c in ("begin", "reply_begin", "reply_end")}
    # At most one row a task, so it can be sent to all.
    return parts.join(F.broadcast(moves), own, "left").select(
        "conv_id",
        (F.col("n") + F.coalesce("turns", F.lit(0))).alias("n"),
        moved["begin"].alias("begin"),
        "piece",
        moved["reply_begin"].alias("reply_begin"),
        moved["reply_end"].alias("reply_end"),
    )


def examples(pieces: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, target, context_end, reply_end.

    The example's text is the stream up to the end of piece ``target``; code points
    from ``context_end`` to ``reply_end`` are trainable, all before is context.
    """
    return pieces.where(F.col("reply_begin").isNotNull()).select(
        "conv_id", F.col("n").alias("target"), F.col("reply_begin").alias("context_end"), "reply_end"
    )


def example_texts(pieces: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """The examples spelled out: conv_id, target, text, context_end, reply_end.

    The size is the sum of all contexts, so choose the examples that are wanted.
    """
    wanted = examples(pieces) if chosen is None else chosen
    before = pieces.select(F.col("conv_id").alias("c"), "n", "piece")
    near = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("n") <= F.col("target"))
    rows = wanted.join(before, near).groupBy("conv_id", "target", "context_end", "reply_end")
    parts = F.array_sort(F.collect_list(F.struct("n", "piece")))
    return rows.agg(F.array_join(F.transform(parts, lambda p: p["piece"]), "").alias("text"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in DIGESTS.split(", ")]
    types = [pa.string() if "sha256" in c else pa.int64() for c in names]

    def emit(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    state, conv, begin, piece = None, None, 0, ""
    for batch in batches:
        done = []
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "begin", "piece", "context_end", "reply_end")]
        for conv_id, at, text, context_end, reply_end in zip(*columns):
            if text is None:  # the example whose target is the piece before
                reply = unescape(piece[context_end - begin : reply_end - begin])
                state[2] += len(reply)
                state[3].update(reply.encode("utf-8", "surrogatepass"))
                state[5] += 1
                state[6] += begin + len(piece)
                continue
            if state is None or not _same(conv_id, conv):
                if state is not None:
                    done.append(_row(conv, state))
                conv, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
            begin, piece = at, text
            role, said = _PARTS.fullmatch(piece).groups()
            state[0] += 1
            state[1].update(f"{unescape_role(role)}\n{unescape(said)}\n".encode("utf-8", "surrogatepass"))
            state[4] += len(piece)
        yield emit(done)
    if state is not None:
        yield emit([_row(conv, state)])


def _row(conv, s):
    return conv, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4], s[5], s[6]


def digests(pieces: DataFrame, chosen: DataFrame) -> DataFrame:
    """Per conversation what its pieces hold and what the ``chosen`` examples train.

    Turns come from the pieces; everything about the loss comes from the examples' rows.
    An example meets the piece that it targets by order, in the one shuffle of the text;
    the digest of a conversation is a running one, so its pieces pass through one task,
    which keeps one of them at a time.
    """
    bound_batches(pieces.sparkSession)
    none = F.lit(None).cast("bigint")
    rows = pieces.select("conv_id", "n", "begin", "piece", none.alias("context_end"), none.alias("reply_end"))
    masks = chosen.select(
        "conv_id", F.col("target").alias("n"), none.alias("begin"), F.lit(None).cast("string").alias("piece"), "context_end", "reply_end"
    )
    rows = rows.unionByName(masks).repartition("conv_id").sortWithinPartitions("conv_id", "n", F.col("piece").isNull())
    return rows.mapInArrow(_digest, DIGESTS)
