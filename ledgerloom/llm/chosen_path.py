"""Operator 11, near-duplicate removal by the Chosen-Path set similarity join.

Every document class has `COORDINATES` minwise values of its shingle set: two sets agree in one of them with the chance of their
Jaccard similarity. A tree starts with all classes in its root. A node with more than `leaf` members chooses coordinates at
random, 1 / t of them on average for a threshold t, none that its path has used, and has a child for each value that members
have there: two sets of similarity t or more share a child on average, those of little similarity part within a level or two. A
node that is small, or holds most of its parent (then its members are similar, and further choices would not part them), is a
leaf. Trees are independent, as many as the target recall asks for.

A leaf is compared exhaustively, but what two leaves repeat is compared once, and members that links have already joined are not
compared again: the counts of both sets first, then all shingles, word for word (`similarity_join.linked`). The number of levels
follows from the data: a child that is not a leaf has four fifths of its parent at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import similarity_join as sj
from .common import cut, fresh, give_back, pieces_for

PERCENT = 85
#: Minwise values of a document: as many as a path's mask has bits.
COORDINATES = 64
#: A pair at the threshold shares a leaf of one tree with a chance of this at least, down to ten levels.
PER_TREE = 0.4
RECALL = 0.9999
LEAF = 128
#: Of a parent, so many tenths in one child make it a leaf.
SIMILAR_TENTHS = 8

_U = np.uint64


def trees_for(recall: float) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - PER_TREE)))


def _odd(n: int) -> np.ndarray:
    return sj._mix(np.arange(1, n + 1, dtype=np.uint64) * _U(0xD1B54A32D192ED03)) | _U(1)


def minwise(sets: list[np.ndarray]) -> list[bytes]:
    """The minwise values of each set, 32 bits each, one after another; nothing for an empty set."""
    full = [i for i, s in enumerate(sets) if len(s)]
    out = [b""] * len(sets)
    if not full:
        return out
    h = np.concatenate([sets[i] for i in full])
    first = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
    values = np.empty((len(full), COORDINATES), dtype="<u4")
    with np.errstate(over="ignore"):
        for c, odd in enumerate(_odd(COORDINATES)):
            values[:, c] = sj._mix(np.minimum.reduceat(h * odd, first)) >> _U(32)
    for i, v in zip(full, values, strict=True):
        out[i] = v.tobytes()
    return out


def branches(node: np.ndarray, used: np.ndarray, values: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, child, mask of the path's coordinates) of each child that the rows' members come into. values: a row of minwise values each."""
    average = 100 / percent
    with np.errstate(over="ignore"):
        dice = sj._mix(node ^ _U(sj._ODD[0]))
        chosen = int(average) + ((dice >> _U(11)).astype(np.float64) / 2.0**53 < average % 1).astype(np.int64)
        rows, children, masks = [], [], []
        taken = used.copy()
        for k in range(int(average) + 1):
            mine = np.flatnonzero((chosen > k) & (taken != _U(0xFFFFFFFFFFFFFFFF)))
            at = (sj._mix(node[mine] + _U((k + 1) * sj._ODD[1] & 0xFFFFFFFFFFFFFFFF)) % _U(COORDINATES)).astype(np.uint64)
            while (busy := taken[mine] >> at & _U(1) > 0).any():
                at[busy] = (at[busy] + _U(1)) % _U(COORDINATES)
            taken[mine] |= _U(1) << at
            value = values[mine, at.astype(np.int64)].astype(np.uint64)
            rows.append(mine)
            children.append(sj._mix(node[mine] ^ sj._mix(at << _U(32) | value)))
            masks.append(used[mine] | _U(1) << at)
    return np.concatenate(rows), np.concatenate(children), np.concatenate(masks)


def _members(rows: DataFrame, percent: int) -> DataFrame:
    """list, used, doc_id, size: the children's members, of rows with node, used, doc_id, size, more (the minwise values)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                values = np.frombuffer(b"".join(batch["more"]), dtype="<u4").reshape(len(batch), COORDINATES)
                row, child, used = branches(batch["node"].to_numpy(dtype=np.int64).view(np.uint64), batch["used"].to_numpy(dtype=np.int64).view(np.uint64), values, percent)
                yield pd.DataFrame({"list": child.view(np.int64), "used": used.view(np.int64), "doc_id": batch["doc_id"].to_numpy()[row], "size": batch["size"].to_numpy()[row], "parent": batch["crowd"].to_numpy()[row]})
            give_back()

    return rows.select("node", "used", "doc_id", "size", "crowd", "more").mapInPandas(run, "list long, used long, doc_id long, size int, parent long")


def leaves(sets: DataFrame, *, percent: int, trees: int, leaf: int = LEAF) -> DataFrame:
    """list, doc_id, size, flags: the members of all trees' leaves; leaves of the same members once. sets: doc_id, size, more."""
    spark = sets.sparkSession
    roots = sj._mix(np.arange(1, trees + 1, dtype=np.uint64) * _U(sj._ODD[2])).view(np.int64).tolist()
    n = sets.count()
    level = sets.withColumns({"node": F.explode(F.array(*[F.lit(r) for r in roots])), "used": F.lit(0).cast("long"), "crowd": F.lit(n).cast("long")})
    found = []
    while True:
        members = _members(level, percent)
        crowds = members.groupBy("list").agg(F.count(F.lit(1)).alias("crowd")).filter("crowd > 1")
        grown = cut(members.join(crowds, "list"))
        small = (F.col("crowd") <= leaf) | (F.col("crowd") * 10 >= F.col("parent") * SIMILAR_TENTHS)
        found.append(grown.filter(small).select("list", "doc_id", "size"))
        rest = grown.filter(~small)
        if rest.isEmpty():
            break
        level = rest.select(F.col("list").alias("node"), "used", "doc_id", "size", "crowd").join(sets.select("doc_id", "more"), "doc_id")
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    names = every.groupBy("list").agg(F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("y"), F.count(F.lit(1)).alias("n"))
    once = names.groupBy("x", "y", "n").agg(F.min("list").alias("list")).select("list")
    return every.join(once, "list", "left_semi").withColumn("flags", F.lit(sj.PROBE + sj.INDEXED))


def near_duplicates(
    docs: DataFrame,
    *,
    percent: int = PERCENT,
    width: int = sj.WORDS,
    recall: float = RECALL,
    leaf: int = LEAF,
    id_col: str = "doc_id",
    text_col: str = "text",
    star_from: int = 16,
    broadcast_rows: int = 1_000_000,
    rows_each: int = 10_000,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (least id of the same words), component_id (least id reachable by links), kept.

    Two documents link when their shingle sets have a Jaccard similarity of percent / 100 or more. Each link is confirmed on the
    full sets; one at the threshold is missed with a chance of 1 - recall at most, those above it with far less. Documents
    without words or text have the empty set and are linked with nothing. One document of each component is kept, that of least
    id, with all rows of this id; rows without an id have the ids of their text's class, and are kept if it has none. An empty table gives no
    rows; other columns are not read.
    """
    named = sj._named(docs, id_col, text_col)
    classed, made = sj.classes(named, width, minwise)
    first = classed.filter("first").select("doc_id", F.col("n_shingles").cast("int").alias("size"))
    if first.isEmpty():
        found = classed.select("doc_id", "n_shingles", "class_id", F.col("class_id").alias("component_id"))
    else:
        # Repeated rows of an id that stands for its class: one of them, and of the text that the class is of.
        sets = made.select("doc_id", "more").filter("doc_id is not null and length(more) > 0").join(first.distinct(), "doc_id").dropDuplicates(["doc_id"])
        sets = cut(sets.coalesce(max(8, pieces_for(classed.count()))))
        texts = sj.representatives(named, classed, broadcast_rows)
        met = leaves(sets, percent=percent, trees=trees_for(recall), leaf=leaf)
        links = sj.linked(met, texts, made, width=width, percent=percent, within=False, star_from=star_from, broadcast_rows=broadcast_rows, rows_each=rows_each)
        found = sj.labelled(classed, sj.components(links))
    return found.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.col("component_id").isNull()))


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that near_duplicates keeps, with their columns, whatever those are called. Rows without an id all stay."""
    name = fresh("going", docs)
    going = near_duplicates(docs, id_col=id_col, **options).filter("not kept and doc_id is not null").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(going, F.col(id_col).cast("long") == F.col(name), "left_anti")
