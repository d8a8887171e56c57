"""Statements that arrive in a drop folder, imported as they come."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.imports import publish_import
from ..sources.shared import settled
from ..sources.snapshots import Store
from ..sources.statements import parse_statements, with_format


class Change(NamedTuple):
    """What a micro-batch did: all transactions as they are now, those that are new, the ledgers (ledger_id) that have new ones."""

    transactions: DataFrame
    new_rows: DataFrame
    ledgers: DataFrame


def statement_stream(spark: SparkSession, drop_dir: str, *, files_each: int = 100) -> DataFrame:
    """file, content, format of each file once, as it appears."""
    lines = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_each).load(drop_dir)
    return with_format(lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content")))


def run_import_stream(
    stream: DataFrame,
    root: str,
    checkpoint: str,
    *,
    ledger_id: str | Column,
    account_id: str | Column,
    on_change: Callable[[Change], None] | None = None,
    clock: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.UTC),
) -> StreamingQuery:
    """Import every micro-batch into the store at root, its files in the order of their names.

    New transactions, a record for each file and its problems are published together, with the epoch's number: an epoch that runs
    again after a failure is not published twice. The ledger is the state: overlapping and late statements add what is missing and nothing
    else, so there is no watermark. ledger_id and account_id are values or are told from the file's name. on_change is called after an epoch that was
    published, to refresh what depends on its ledgers.
    """

    def step(files: DataFrame, epoch: int) -> None:
        spark = files.sparkSession
        store, name = Store(spark, root), _name(spark, checkpoint)
        before = store.snapshot()
        if before.marks.get(name, -1) >= epoch:
            return
        owner = {c: v if isinstance(v, Column) else F.lit(v) for c, v in (("ledger_id", ledger_id), ("account_id", account_id))}
        files = settled(files.withColumns(owner))
        batches = files.select("ledger_id", F.col("file").alias("id"), "account_id", F.col("format").alias("source"), F.regexp_extract("file", "[^/]*$", 0).alias("file_name"))
        statements = parse_statements(files)
        of_file = files.select("file", *owner)
        parsed = statements.parsed.join(of_file, "file").withColumns({"batch_id": F.col("file"), "batch_seq": F.col("file")})
        problems = statements.problems.join(of_file, "file").withColumn("batch_id", F.col("file"))
        now = publish_import(store, batches, parsed, problems, imported_at=clock(), mark=(name, epoch))
        if on_change is not None:
            new_rows = store.read_folders("transactions", [f for f in now.folders["transactions"] if f not in before.folders["transactions"]])
            on_change(Change(store.read("transactions", now.number), new_rows, new_rows.select("ledger_id").distinct()))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()


def _name(spark: SparkSession, checkpoint: str) -> str:
    """The stream's own id, which its checkpoint keeps: with a new checkpoint the numbers of epochs start again, under another id."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/metadata")
    source = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))["id"]
    finally:
        source.close()
