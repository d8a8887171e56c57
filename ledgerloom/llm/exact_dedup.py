"""Operator 7, exact dedup by composable polynomial fingerprints.

A normalised text's bytes are the digits of a number in base 256; its fingerprint is that number modulo
a prime. Chunks are hashed by themselves, and the fingerprints of two neighbours combine as
`left * 256 ** length_of_right + right`, so the chunks of a huge document can be hashed in any place and
order. Documents of one fingerprint are then compared chunk by chunk: for each chunk number the least
and the greatest chunk of the group are kept, which are the same if and only if all are. These are
aggregates that combine before the shuffle, so a group of any size costs each task one row per chunk.
A group in which some chunk differs is divided by the SHA-256 of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh

#: A prime of 127 bits, so that fingerprints of different texts practically never meet.
PRIME = (1 << 127) - 577
CHUNK = 1 << 16
#: Bytes of a text from which on its chunks are hashed in tasks of their own.
HUGE = 1 << 20
_DROPPED = b" \t\n\x0b\x0c\r"


def fingerprint(chunk: bytes) -> int:
    return int.from_bytes(chunk, "big") % PRIME


def combine(left: int, right: int, right_length: int) -> int:
    """The fingerprint of two stretches in a row."""
    return (left * pow(256, right_length, PRIME) + right) % PRIME


def fingerprint_of(chunks: Iterator[bytes]) -> int:
    value = 0
    for c in chunks:
        value = combine(value, fingerprint(c), len(c))
    return value


def _normal(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(None, _DROPPED) if isinstance(text, str) else b""


def _spread(docs: DataFrame, kind: str, chunk: int) -> DataFrame:
    """The rows of `fingerprints` for huge texts: chunks are dealt over tasks and hashed there; what comes together again is a
    fingerprint and a length per chunk. Rows of equal id and content share their chunks' hashes."""
    body = docs.select("doc_id", F.length("text").cast("long").alias("n_points"), F.translate("text", " \t\n\x0b\x0c\r", "").cast("binary").alias("_body"))
    numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), ((F.octet_length("_body") - 1) / chunk).cast("int")))
    parts = F.transform(numbers, lambda i: F.substring("_body", i * chunk + 1, F.lit(chunk)))
    whole = ["doc_id", "n_points", "n_norm", "text_sha256"]
    chunks = body.select("doc_id", "n_points", F.octet_length("_body").cast("long").alias("n_norm"), F.sha2("_body", 256).alias("text_sha256"), F.posexplode(parts).alias("_no", "_chunk"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = batch.drop(columns="_chunk")
            yield found.assign(_fp=[f"{fingerprint(bytes(c)):032x}" for c in batch["_chunk"]], _length=[len(c) for c in batch["_chunk"]])

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, value = pdf.sort_values("_no"), 0
        for fp, length in zip(pdf["_fp"], pdf["_length"].tolist(), strict=True):
            value = combine(value, int(fp, 16), length)
        rows = pdf.iloc[[0] * int(pdf["_copies"].iloc[0])]
        return rows[["doc_id", "n_points", "n_norm"]].assign(fp=f"{value:032x}", text_sha256=rows["text_sha256"])

    return (
        chunks.repartition(*whole, "_no")
        .mapInPandas(hashed, f"doc_id {kind}, n_points long, n_norm long, text_sha256 string, _no int, _fp string, _length long")
        .groupBy(*whole, "_no")
        .agg(F.first("_fp").alias("_fp"), F.first("_length").alias("_length"), F.count(F.lit(1)).alias("_copies"))
        .groupBy(*whole)
        .applyInPandas(joined, f"doc_id {kind}, n_points long, n_norm long, fp string, text_sha256 string")
    )


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", huge: int = HUGE, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_points (of the original text), n_norm (bytes of the normalised one), fp, text_sha256: one row per document.

    The chunks of texts above `huge` bytes are hashed in different tasks, those of other texts one after another.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            normal = [_normal(t) for t in texts]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].to_numpy(),
                    "n_points": [len(t) if isinstance(t, str) else 0 for t in texts],
                    "n_norm": [len(b) for b in normal],
                    "fp": [f"{fingerprint_of(b[i : i + chunk] for i in range(0, len(b), chunk)):032x}" for b in normal],
                    "text_sha256": [hashlib.sha256(b).hexdigest() for b in normal],
                }
            )

    kind = docs.schema[id_col].dataType.simpleString()
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    is_huge = F.coalesce(F.octet_length("text"), F.lit(0)) > huge
    few = named.filter(~is_huge).mapInPandas(run, f"doc_id {kind}, n_points long, n_norm long, fp string, text_sha256 string")
    return few.unionByName(_spread(named.filter(is_huge), kind, chunk))


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 1_000_000, chunk: int = CHUNK, huge: int = HUGE) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting ASCII white space; null counts as empty, and all
    such texts are one group. Of equal texts the one of most code points, then of least id, is kept.
    Rows that share an id with the kept row all have kept = true. An empty table gives no rows; other
    columns are not read. Group sizes are aggregated before any shuffle.
    """
    rows = cut(fingerprints(docs, id_col=id_col, text_col=text_col, huge=huge))
    # Equal fingerprint and length: candidates, to be compared by content.
    suspects = rows.groupBy("fp", "n_norm").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    ids = cut(rows.join(suspects.drop("_n"), ["fp", "n_norm"]).select("doc_id", "fp", "n_norm").distinct())
    keyed = F.broadcast(ids) if ids.count() <= broadcast_rows else ids
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), " \t\n\x0b\x0c\r", "")
    body = docs.select(F.col(id_col).alias("_id"), text.alias("_body"))
    chunks = (
        body.join(keyed, F.col("_id").eqNullSafe(F.col("doc_id")))
        .select("fp", "n_norm", F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.length("_body") - 1) / chunk).cast("int")), lambda i: F.substring("_body", i * chunk + 1, F.lit(chunk)))).alias("_no", "_chunk"))
    )
    differing = (
        chunks.groupBy("fp", "n_norm", "_no")
        .agg(F.min("_chunk").alias("_least"), F.max("_chunk").alias("_most"))
        .filter("_least <> _most")
        .select("fp", "n_norm")
        .distinct()
        .withColumn("_apart", F.lit(True))
    )
    classed = rows.join(differing, ["fp", "n_norm"], "left").withColumn("_class", F.concat_ws(":", "fp", "n_norm", F.when(F.col("_apart"), F.col("text_sha256"))))
    # A written table on this side: then adaptive execution can split a class of very many rows on the other.
    groups = cut(classed.groupBy("_class").agg(
        F.min(F.struct((-F.col("n_points")).alias("points"), F.col("doc_id").alias("id")))["id"].alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    ))
    return classed.join(groups, "_class").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that are kept, with their columns, whatever their names.

    Nulls, empty texts, ties and empty tables are as in exact_duplicates. Rows of one id stay or go
    together: they go if any of them is not kept, which cannot be where they are equal.
    """
    name = fresh("dropped", docs)
    found = exact_duplicates(docs, id_col=id_col, text_col=text_col, **options).filter("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(found, F.col(id_col).eqNullSafe(F.col(name)), "left_anti")


__all__ = ["CHUNK", "HUGE", "PRIME", "combine", "deduplicated", "exact_duplicates", "fingerprint", "fingerprint_of", "fingerprints"]
