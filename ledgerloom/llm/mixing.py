"""Operator 10, mixing sources to target weights. DataFrame functions only.

Documents get hash-random keys; within a source they are taken in the order of the keys until the
source's budget of words is used, in whole passes (epochs) first if the budget is larger than the
source. The running sums are distributed: a source's keys fall into buckets, each bucket's sum is
added to those before it, and only a bucket is ever sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, buckets_for, cut, key_bucket, seeded_key

#: A source gives at most so many times its own size.
MAX_EPOCHS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), max_epochs: int = MAX_EPOCHS, share: float = 1.0) -> DataFrame:
    """(source, source_size) -> with target added.

    Sources by code point, null last, weigh `weights`, repeating. All targets together are `share` of
    all words. A target stops at max_epochs times its source's size; the excess is shared anew by
    weight, until none is above. That has a closed form: with c = cap / weight, the sources of the
    smallest c stop at their caps and the others get weight times one level, so one running sum over
    the sources by c finds where the level lies. The table has a row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn("_w", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))).withColumn(
        "_cap", (F.col("source_size") * max_epochs).cast("double")
    )
    everyone = Window.partitionBy()
    by_fill = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source")
    # What is left, for those from this one on, once all before it have stopped at their caps.
    so_far = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everyone) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(so_far), F.lit(0.0))
    weight_left = F.sum("_w").over(everyone) - F.coalesce(F.sum("_w").over(so_far), F.lit(0.0))
    leveled = weighed.withColumn("_level", left / weight_left).withColumn("_free", F.col("_level") * F.col("_w") <= F.col("_cap"))
    level = F.min(F.when(F.col("_free"), F.struct(F.col("_cap") / F.col("_w"), F.col("_level")))).over(everyone)
    return leveled.select(
        "source",
        "source_size",
        F.least(F.col("_cap"), F.coalesce(level["_level"] * F.col("_w"), F.col("_cap"))).alias("target"),
    )


def mix_plan(
    docs: DataFrame,
    weights: Sequence[float] = (1, 2, 3),
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "mix-1",
    max_epochs: int = MAX_EPOCHS,
    rows_each: int = 20_000,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, epochs, source.

    epochs says how often the mix holds the document, taken is size * epochs. Documents stay whole:
    the last pass ends at the document border nearest the budget, so a source's taken words are off
    its target by half a document at most, and no document is taken more than max_epochs times.
    A null or blank text has size 0; it is in as many epochs as its place in the order says. Null is
    a source of its own. Equal rows are documents of their own. An empty table gives no rows. Columns
    but the three named ones are not read.
    """
    return _placed(docs, weights, id_col, text_col, source_col, seed, max_epochs, rows_each, []).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("epochs")).alias("taken"), "epochs", "source"
    )


def _placed(docs: DataFrame, weights: Sequence[float], id_col: str, text_col: str, source_col: str, seed: str, max_epochs: int, rows_each: int, more: list[Column]) -> DataFrame:
    """The plan with further columns of docs, which go along to where a row gets its epochs."""
    keyed = docs.select(
        F.col(id_col).alias("doc_id"), word_count(F.col(text_col)).alias("size"), F.col(source_col).cast("string").alias("source"), *more
    ).withColumn("_key", seeded_key(seed, "source", "doc_id"))
    rows = cut(keyed.select("doc_id", "size", "source", "_key"))
    buckets = buckets_for(rows.count(), rows_each)
    bucket = key_bucket(F.col("_key"), buckets)
    per_bucket = cut(rows.groupBy("source", bucket.alias("_bucket")).agg(F.sum("size").alias("_sum")))
    targets = source_targets(per_bucket.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, max_epochs)
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        per_bucket.withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), "_start")
        .join(targets.withColumnRenamed("source", "_t"), F.col("_s").eqNullSafe(F.col("_t")))
    )
    rows = (keyed if more else rows).withColumn("_bucket", bucket)
    running = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumn("_upto", F.sum("size").over(running))
        .join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
        .withColumn("_middle", F.col("_start") + F.col("_upto") - F.col("size") / 2)
        .withColumn("_passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
        .withColumn("epochs", F.col("_passes") + (F.col("_middle") <= F.col("target") - F.col("_passes") * F.col("source_size")).cast("int"))
        .withColumn("epochs", F.least(F.col("epochs"), F.lit(max_epochs)))
    )


def mixed_documents(
    docs: DataFrame,
    weights: Sequence[float] = (1, 2, 3),
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "mix-1",
    max_epochs: int = MAX_EPOCHS,
    rows_each: int = 20_000,
) -> DataFrame:
    """The mix itself: every row of docs as often as the epochs of mix_plan say, with all its columns, whatever their names.

    Each row has epochs of its own, those that repeat an id too. Nulls, empty texts, ties and empty tables are as in mix_plan.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    placed = _placed(docs, weights, id_col, text_col, source_col, seed, max_epochs, rows_each, [row])
    return placed.filter("epochs > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("epochs"))).alias("_epoch")).select("_row.*")
