"""Operator 6, sharding by proportional stratified interleaving. DataFrame functions only.

Rows of each source are shuffled by a seeded hash key and ranked; a row's fractional rank is
(rank + 1/2) / rows of its source. Sorted by that fraction, every stretch of the order holds each
source in its share of the whole, so cutting the order into runs of equal length gives shards that
all match the mixture.

No rank is taken over a whole source: a hot source is ranked in buckets of its hash keys, and a
bucket's rank starts after the rows of the buckets before it. The same is done for the global order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for, cut, key_bucket, seeded_key, utf8_length


def interleaved_shards(
    docs: DataFrame,
    shards: int = 8,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "shard-1",
    rows_each: int = 20_000,
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, source.

    Law `rows`: shard sizes differ by one row at most, overall and (to a row or two) per source.
    A null text has size 1 and the checksum of nothing; null is a source of its own. Rows that repeat
    are ranked like any others, each getting a slot of its own. An empty table gives no rows. Only the
    three named columns are read, so further columns, whatever their names, do not matter.
    """
    rows = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (utf8_length(F.col(text_col)) + 1).alias("size"),
            F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
            F.col(source_col).cast("string").alias("source"),
        ).withColumn("_key", seeded_key(seed, "source", "doc_id"))
    )
    total = rows.count()
    buckets = buckets_for(total, rows_each)
    rows = rows.withColumn("_bucket", key_bucket(F.col("_key"), buckets))

    per_bucket = rows.groupBy("source", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    by_source = Window.partitionBy("source")
    before = by_source.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.select(
        F.col("source").alias("_s"),
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
        F.sum("_n").over(by_source).alias("_source_rows"),
    )
    in_bucket = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "text_crc32", "size")
    ranked = (
        rows.withColumn("_rn", F.row_number().over(in_bucket) - 1)
        .join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
        .withColumn("_fraction", (F.col("_start") + F.col("_rn") + F.lit(0.5)) / F.col("_source_rows"))
    )

    # The fractions are spread evenly over 0 to 1, so equal ranges of them hold about as many rows each.
    ranked = cut(
        ranked.select("doc_id", "size", "text_crc32", "source", "_key", "_fraction").withColumn("_range", F.floor(F.col("_fraction") * buckets).cast("long"))
    )
    range_starts = (
        ranked.groupBy("_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            F.col("_range").alias("_r"),
            F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        )
    )
    in_range = Window.partitionBy("_range").orderBy("_fraction", "_key", "doc_id", "text_crc32", "size")
    placed = (
        ranked.withColumn("_rn", F.row_number().over(in_range) - 1)
        .join(range_starts, F.col("_range") == F.col("_r"))
        .withColumn("_place", (F.col("_before") + F.col("_rn")).cast("long"))
    )
    # Shard s holds the places from ceil(s * total / shards) on.
    shard = F.floor(F.col("_place") * shards / F.lit(max(total, 1))).cast("int") if total * shards < 2**52 else F.expr(f"cast(_place * {shards} div {total} as int)")
    first = F.ceil(F.col("shard").cast("decimal(20,0)") * total / shards).cast("long")
    return placed.withColumn("shard", shard).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("_place") - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )
