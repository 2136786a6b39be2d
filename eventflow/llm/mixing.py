"""Mixing sources to target weights, with DataFrame functions only.

Sizes are words.  Every row gets a hash-random key; within each source rows are ranged
by that key and cut where the running sum of sizes meets the source's budget.  The
running sum is made in two steps that never bring a source to one task: rows go to
buckets (the leading part of the key; as many as the row count asks for), bucket totals
are summed up in order, and within a bucket a window adds the rows before.  Whole
epochs are taken first, the cut makes up the rest, so a source ends at its exact budget
(the row at the cut gives only part of its words).

A null source is a source of its own, placed last; a null or empty text has size 0; very
long texts are counted whole.  Null or repeated ids are allowed: keys are of id and text, so only rows alike in both
tie, and those are exchangeable.  An empty table gives an empty mix.  Columns may be called anything: ``mix_sources`` refuses
to return one that is called like its own, ``mixed_corpus`` gives its two the next free names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventflow.llm.common import WORD, col, free_names, shuffle_partitions

PATTERN_WEIGHTS = (3, 1, 2)
_SRC, _NONE = "__src", "__none"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, max_epochs: float = 2.0, weights: tuple[int, ...] = PATTERN_WEIGHTS) -> DataFrame:
    """(source columns, source_size) to the same and ``target``: one row per source.

    Targets are weight * level, stopped at ``max_epochs`` times the source's size; the level is the
    one at which they add up to ``share`` of all sizes (what resharing the excess until none is above ends at).
    """
    order = Window.orderBy(_NONE, F.encode(_SRC, "utf-8"))  # one row per source, not per document
    every = Window.partitionBy(F.lit(1))
    placed = (
        sizes.withColumn("__n", F.row_number().over(order) - 1)
        .withColumn("__w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__n") % len(weights) + 1).cast("int")))
        .withColumn("__cap", F.col("source_size") * max_epochs)
        .withColumn("__total", F.sum("source_size").over(every) * share)
    )
    placed = placed.withColumn("__ratio", F.col("__cap") / F.col("__w"))
    up = Window.orderBy("__ratio", "__n")
    before, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    # The level if exactly the sources before this one are full; it holds at the first source that it does not fill.
    levels = placed.withColumn("__level", (F.col("__total") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__w").over(after))
    first = F.min(F.when(F.col("__level") <= F.col("__ratio"), F.struct("__ratio", "__n", "__level"))).over(every)
    return levels.withColumn("__at", first["__level"]).select(_SRC, _NONE, "source_size", F.coalesce(F.least(F.col("__cap"), F.col("__at") * F.col("__w")), F.col("__cap")).alias("target"))


def _placed(docs: DataFrame, columns: list[str], ours: list[str], id_col: str, text_col: str, source_col: str, share: float, max_epochs: float, weights: tuple[int, ...], seed: int, rows_per_bucket: int) -> DataFrame:
    """``columns`` of every row and, under the names ``ours``, its size, its source's size and target, and the words that the mix takes of it."""
    size, source_size, target, taken = ours
    kept = [f"__c{i}" for i in range(len(columns))]  # under names of our own, so that none can clash with the inner ones
    src = col(source_col).cast("string")
    sized = docs.select(
        *[col(c).alias(k) for c, k in zip(columns, kept, strict=True)], word_count(col(text_col)).alias("size"), F.coalesce(src, F.lit("")).alias(_SRC), src.isNull().alias(_NONE),
        F.xxhash64(F.lit(seed), col(id_col), col(text_col)).alias("__key"), F.xxhash64(F.lit(seed + 1), col(text_col)).alias("__tie"),
    )
    n_rows = docs.count()
    buckets = max(shuffle_partitions(docs.sparkSession), math.ceil(n_rows / rows_per_bucket))
    low = -float(1 << 63)
    sized = sized.withColumn("__bucket", F.least(F.floor((F.col("__key").cast("double") - low) / (2.0**64) * buckets), F.lit(buckets - 1)).cast("int"))
    per_bucket = sized.groupBy(_SRC, _NONE, "__bucket").agg(F.sum("size").alias("__in"))
    targets = source_targets(per_bucket.groupBy(_SRC, _NONE).agg(F.sum("__in").alias("source_size")), share, max_epochs, weights)
    ahead = Window.partitionBy(_SRC, _NONE).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.withColumn("__before", F.coalesce(F.sum("__in").over(ahead), F.lit(0))).drop("__in").join(targets, [_SRC, _NONE])
    inside = Window.partitionBy(_SRC, _NONE, "__bucket").orderBy("__key", "__tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("__ahead", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, [_SRC, _NONE, "__bucket"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.round(F.col("target")).cast("long") - epochs * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("__before") - F.col("__ahead")))
    made = [F.col("size").alias(size), F.col("source_size").alias(source_size), F.col("target").alias(target), (epochs * F.col("size") + cut).cast("long").alias(taken)]
    return placed.select(*[F.col(k).alias(c) for c, k in zip(columns, kept, strict=True)], *made)


def mix_sources(
    docs: DataFrame, columns: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    share: float = 1.5, max_epochs: float = 2.0, weights: tuple[int, ...] = PATTERN_WEIGHTS, seed: int = 17, rows_per_bucket: int = 50_000,
) -> DataFrame:
    """``columns`` of every row (default: the id) with size, source_size, target and taken (words the mix takes, repeats counted)."""
    columns = [id_col] if columns is None else columns
    ours = ["size", "source_size", "target", "taken"]
    if clash := {c.lower() for c in columns} & set(ours):
        raise ValueError(f"columns {sorted(clash)} are made here; rename them first")
    return _placed(docs, columns, ours, id_col, text_col, source_col, share, max_epochs, weights, seed, rows_per_bucket)


def mixed_corpus(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    share: float = 1.5, max_epochs: float = 2.0, weights: tuple[int, ...] = PATTERN_WEIGHTS, seed: int = 17, rows_per_bucket: int = 50_000,
) -> DataFrame:
    """The mix itself: each row as often as the mix takes it, with ``epoch`` (from 1) and ``words_taken`` of that time (both with underscores after them where the rows have such columns).

    All columns stay; texts stay whole (at a source's cut, ``words_taken`` says how many of the words count).
    Rows with no word take no room and stay once.
    """
    epoch, words_taken, *ours = free_names(docs.columns, "epoch", "words_taken", "__size", "__source_size", "__target", "__taken")
    mixed = _placed(docs, docs.columns, ours, id_col, text_col, source_col, share, max_epochs, weights, seed, rows_per_bucket)
    size, all_taken = F.col(ours[0]), F.col(ours[3])
    times = F.greatest(F.ceil(all_taken / F.greatest(size, F.lit(1))).cast("int"), F.when(size == 0, 1).otherwise(0))
    taken = F.least(size, all_taken - (F.col(epoch) - 1) * size)
    return mixed.where(times > 0).withColumn(epoch, F.explode(F.sequence(F.lit(1), times))).withColumn(words_taken, taken.cast("long")).select(*[col(c) for c in docs.columns], epoch, words_taken)
