"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions.

A source's target is its share by weight of all words, at most ``max_epochs`` times its
own words; the rest is shared again by weight. Whole epochs come first: every document
is taken floor(target / size) times. What is left of the target is filled by a weighted
sample: each document draws an exponential key, divided by its quality weight, and the
documents with the smallest keys are taken while the prefix sum of their words stays
within the budget, to the nearest document.

The prefix sums are never taken over a whole source. Words are summed by 4,096 ranges of
the key, then by 4,096 parts of the one range that holds the limit, and only the few
documents of the part that holds it are put in order. The limit is one key per source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scale import small_side, stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
MIN_QUALITY = 0.25
SYMBOLS = "!#$%&*|<>{}[]=@~^+"
PARTS = 4096


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def quality_weight(text: Column) -> Column:
    """From MIN_QUALITY to 1: falls with the share of signs that prose has few of."""
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    share = symbols / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.greatest(F.lit(MIN_QUALITY), 1.0 - 5.0 * share), F.lit(MIN_QUALITY))


def sampling_key(id: Column, text: Column, weight: Column) -> Column:
    """An exponential key with the weight as its rate, drawn from a digest of the row."""
    row = F.concat(F.coalesce(id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    number = F.conv(F.substring(F.md5(row.cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.ln((number + 0.5) / float(1 << 52)) / weight


def _rows(docs: DataFrame, quality: Column | None) -> DataFrame:
    """The caller's row as one column, beside what the mix needs of it.

    ``__row`` tells apart rows of one id and text that differ elsewhere.
    """
    weight = quality_weight(F.col("text")) if quality is None else quality
    types = dict(docs.dtypes)
    hashed = [F.col(f"`{c}`") for c in docs.columns if "map<" not in types[c] and "variant" not in types[c]]
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"),
        F.col("doc_id").alias("__id"),
        F.col("source").alias("__source"),
        word_count(F.col("text")).alias("__size"),
        sampling_key(F.col("doc_id"), F.col("text"), weight).alias("__key"),
        F.xxhash64(*hashed).alias("__row"),
    )


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) for one row per source.

    Weights go to the sources in code point order, null last, and repeat. Sources whose
    share is above their limit are those with the least room per weight; with the
    sources in that order the level at which the rest shares is a prefix sum.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1)
    rows = sizes.withColumn("w", weight).withColumn("room", max_epochs * F.col("source_size").cast("double"))
    by_room = Window.orderBy(F.col("room") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("room").over(before), F.lit(0.0))
    shared = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / shared)
    fits = F.col("level") * F.col("w") <= F.col("room")
    first = F.min(F.when(fits, F.struct(F.col("room") / F.col("w"), F.col("level").alias("level")))).over(everything)
    open_level = first["level"]
    target = F.least(F.col("room"), open_level * F.col("w"))
    return rows.select("source", "source_size", F.coalesce(target, F.col("room")).alias("target"))


SLIM = ["__id", "__source", "__size", "__key", "__row"]
GROUP = ["__source", "__key", "__id", "__row"]
# Copies of one row that a task hands out at a time.
COPIES = 100_000


def _limit(parts: DataFrame, plan: DataFrame, part: str) -> DataFrame:
    """Per source the part of the key range in which the budget runs out, and the words before it."""
    running = Window.partitionBy("__source").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    rows = parts.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
    held = rows.join(small_side(plan), F.col("__source").eqNullSafe(F.col("p_source")))
    filled = F.col("done") + F.col("before")
    inside = held.where((filled <= F.col("budget")) & (filled + F.col("words") > F.col("budget")))
    return inside.select("p_source", "budget", filled.alias("done"), F.col(part).alias(f"cut_{part}"))


def plan_mix(
    rows: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS
) -> tuple[DataFrame, DataFrame]:
    """(plan, edges) from the slim rows of all documents.

    The plan has one row per source: source_size, target, ``epochs``, ``budget`` for the
    sampled part and the range ``cut_fine`` of the key in which it runs out (null if it
    takes all). ``edges`` has the groups of equal rows in that range, their number
    ``e_n`` and how many of them, ``e_taken``, the sample takes.
    """
    sizes = rows.groupBy(F.col("__source").alias("source")).agg(F.sum("__size").alias("source_size"))
    shares = targets(sizes, weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = stage(
        shares.withColumn("epochs", whole.cast("bigint"))
        .withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumnRenamed("source", "p_source"),
        "mix-plan",
    )
    keyed = rows.where(F.col("__size") > 0).withColumns(
        {"coarse": F.floor(_place() * PARTS), "fine": F.floor(_place() * (PARTS * PARTS))}
    )
    start = plan.select("p_source", "budget", F.lit(0).cast("bigint").alias("done"))
    coarse = keyed.groupBy("__source", "coarse").agg(F.sum("__size").alias("words"))
    cut = stage(_limit(coarse, start, "coarse"), "mix-coarse")
    near = keyed.join(
        small_side(cut), F.col("__source").eqNullSafe(F.col("p_source")) & (F.col("coarse") == F.col("cut_coarse"))
    )
    # Equal rows are one row with a number from here on, however many they are.
    near = near.groupBy(*GROUP, "fine").agg(F.max("__size").alias("__size"), F.count(F.lit(1)).alias("e_n"))
    near = stage(near, "mix-near")
    fine = near.groupBy("__source", "fine").agg(F.sum(F.col("__size") * F.col("e_n")).alias("words"))
    cut = stage(_limit(fine, cut.drop("cut_coarse"), "fine"), "mix-fine")

    last = near.join(
        small_side(cut), F.col("__source").eqNullSafe(F.col("p_source")) & (F.col("fine") == F.col("cut_fine"))
    )
    order = Window.partitionBy("__source").orderBy("__key", "__id", "__row")
    words = F.sum(F.col("__size") * F.col("e_n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    # The i-th of equal rows is taken while the words up to its middle are within the budget.
    room = F.col("budget") - F.col("done") - F.coalesce(words, F.lit(0)) - F.col("__size") / 2.0
    taken = F.least(F.col("e_n"), F.greatest(F.lit(0), F.floor(room / F.col("__size")) + 1)).cast("bigint")
    edges = last.select(*[F.col(c).alias(f"e{c}") for c in GROUP], "e_n", taken.alias("e_taken"))
    limits = cut.select(F.col("p_source").alias("c_source"), "cut_fine")
    with_cut = plan.join(small_side(limits), F.col("p_source").eqNullSafe(F.col("c_source")), "left").drop("c_source")
    return stage(with_cut, "mix-limits"), stage(edges, "mix-edges")


def _place() -> Column:
    """From 0 to 1 by the key. A rate of MIN_QUALITY makes no part of the range hold much
    more than its share."""
    return 1.0 - F.exp(-F.col("__key") * MIN_QUALITY)


def _times(rows: DataFrame, plan: DataFrame, edges: DataFrame, carried: str | None = None) -> DataFrame:
    """Rows with their source's plan and ``__times``, how often each is taken.

    Of equal rows of which only some are taken, any will do: they are counted, and the
    number is handed out again in runs of COPIES, so no task holds them all.
    """
    keep = [*SLIM, *([carried] if carried else [])]

    def planned(some: DataFrame) -> DataFrame:
        joined = some.join(small_side(plan), F.col("__source").eqNullSafe(F.col("p_source")))
        same = F.lit(True)
        for c in GROUP:
            same = same & F.col(c).eqNullSafe(F.col(f"e{c}"))
        return joined.join(small_side(edges), same, "left")

    partly = (F.col("e_taken") > 0) & (F.col("e_taken") < F.col("e_n"))
    place = F.floor(_place() * (PARTS * PARTS))
    sampled = (
        F.when(F.col("budget") <= 0, F.lit(False))
        .when(F.col("cut_fine").isNull(), F.lit(True))
        .when(place < F.col("cut_fine"), F.lit(True))
        .when(place > F.col("cut_fine"), F.lit(False))
        .otherwise(F.coalesce(F.col("e_taken") > 0, F.lit(False)))
    )
    out = [*keep, "source_size", "target"]
    split = edges.where(partly)
    times = (F.col("epochs") + sampled.cast("bigint")).alias("__times")
    if split.isEmpty():
        return planned(rows).select(*out, times)
    whole = planned(rows).where(~F.coalesce(partly, F.lit(False))).select(*out, times)
    ids = split.select(F.col("e__id").alias("s_id")).distinct()
    some = rows.join(small_side(ids), F.col("__id").eqNullSafe(F.col("s_id")), "left_semi")
    extra = [F.first(carried).alias(carried)] if carried else []
    groups = planned(some).where(partly).groupBy(*GROUP).agg(
        *[F.max(c).alias(c) for c in ("__size", "source_size", "target", "epochs", "e_taken", "e_n")], *extra
    )
    runs = groups.withColumn("run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("e_n") - 1) / COPIES))))
    spread = runs.repartition(*GROUP, "run")
    first, last = F.col("run") * COPIES + 1, F.least((F.col("run") + 1) * COPIES, F.col("e_n"))
    each = spread.withColumn("nth", F.explode(F.sequence(first, last)))
    again = each.select(*out, (F.col("epochs") + (F.col("nth") <= F.col("e_taken")).cast("bigint")).alias("__times"))
    return whole.unionByName(again)


def mix_sizes(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    quality: Column | None = None,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    ``docs`` has doc_id, text and source, each of which may be null; other columns only
    tell rows apart, whatever their names. A source without words has the target 0. Of
    rows that are equal in all columns as many are taken as fit. Equal input gives equal
    output, however it is partitioned.
    """
    slim = stage(_rows(docs, quality).select(*SLIM), "mix-rows")
    plan, edges = plan_mix(slim, weights, max_epochs)
    return _times(slim, plan, edges).select(
        F.col("__id").alias("doc_id"),
        F.col("__size").alias("size"),
        "source_size",
        "target",
        (F.col("__size") * F.col("__times")).alias("taken"),
    )


def mix_documents(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    quality: Column | None = None,
) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns."""
    rows = _rows(docs, quality)
    plan, edges = plan_mix(stage(rows.select(*SLIM), "mix-rows"), weights, max_epochs)
    taken = _times(rows, plan, edges, "__doc").where(F.col("__times") > 0)
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__times"))).alias("__copy")
    return taken.select("__doc", copies).select("__doc.*")
