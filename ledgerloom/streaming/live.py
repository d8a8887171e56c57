"""Queries over accounts, categories and classifications that tell of changes as edits arrive."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.snapshots import Store
from .imports import _name


def latest(edits: DataFrame, key: Sequence[str], version: Sequence[str] = ("version",)) -> DataFrame:
    """The latest edit of each key, of streams and of tables: of edits with one version, the one of greatest values. A stream keeps one row of
    state per key, and in update mode tells of the keys that a trigger has edits of."""
    rest = [c for c in edits.columns if c not in (*key, *version)]
    last = edits.groupBy(*key).agg(F.max(F.struct(*version, *rest)).alias("_last"))
    return last.select(*key, *[F.col("_last")[c].alias(c) for c in (*version, *rest)])


def run_live_query(
    edits: DataFrame,
    root: str,
    checkpoint: str,
    *,
    schema: str,
    key: Sequence[str],
    version: Sequence[str] = ("version",),
    deleted: str = "is_deleted",
    on_change: Callable[[DataFrame], None] | None = None,
) -> StreamingQuery:
    """Keep a table of the latest rows by key, published at root, up to date with a stream of edits, and tell on_change of the rows that an epoch
    changes: each with is_deleted, so that whoever shows them can take them away. Edits that come late, behind a
    later version, change nothing and are not told. An epoch that runs again changes nothing either. The table has no deleted rows; the
    batch queries of the library read it."""

    def step(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        store, name = Store(spark, root, {"rows": schema}), _name(spark, checkpoint)
        base = store.snapshot()
        if base.marks.get(name, -1) >= epoch:
            return
        held = store.read_folders("rows", base.folders["rows"])
        values = [c for c in held.columns if c not in key]
        new, old = F.struct(*[F.col(f"n.{c}") for c in values]), F.struct(*[F.col(f"o.{c}") for c in values])
        same = [F.col(f"n.{c}") == F.col(f"o.{c}") for c in key]
        joined = rows.alias("n").join(held.alias("o"), same, "left")
        known = F.col(f"o.{key[0]}").isNotNull()
        gone = F.coalesce(F.col(f"n.{deleted}"), F.lit(False))
        changed = joined.filter(F.when(gone, known).otherwise(~known | ~new.eqNullSafe(old))).select("n.*")
        # The update names the keys that it has edits of, changed or not, so one join gives the table anew.
        kept = held.join(rows.select(*key), list(key), "left_anti")
        table = kept.select(*held.columns).unionByName(rows.filter(~F.coalesce(F.col(deleted), F.lit(False))).select(*held.columns))
        folder = store.write("rows", table)
        if on_change is not None:
            on_change(changed)
        store.publish(base, replaced={"rows": folder}, mark=(name, epoch))

    return latest(edits, key, version).writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint).start()
