"""Ledger tables that are published as a whole, or not at all.

Below a root, `data/` holds folders of Parquet files and `published/` small files with growing numbers. Such a file names the folders
that make up each table; the one of the highest number is what readers see. A change writes new folders first, which nobody
reads yet, and then the file with the next number, under another name and renamed last. A job that dies before the rename leaves
the tables as they were; its folders are never read. The rename fails if the number is taken, so of two jobs that change the same
tables at once one finds out and starts again from what the other published.

A published file also keeps `marks`: for a stream, the last epoch that is in. An epoch that runs again is not published again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from .schemas import BATCH_PROBLEMS, IMPORT_BATCHES, TRANSACTIONS

TABLES = {"transactions": TRANSACTIONS, "import_batches": IMPORT_BATCHES, "problems": BATCH_PROBLEMS}
#: By what the files of a table are clustered, so that a reader of few ledgers skips the rest by the files' statistics.
ORDER = {"transactions": ["ledger_id", "merchant_key", "posted_date"], "import_batches": ["ledger_id", "id"], "problems": ["ledger_id", "batch_id"]}


class Conflict(RuntimeError):
    """Another job has published in the meantime."""


class Snapshot(NamedTuple):
    """What is published: a number (0: nothing yet), the folders of each table, the marks."""

    number: int
    folders: dict[str, list[str]]
    marks: dict[str, int]


class Unfinished(NamedTuple):
    """Rows to be written, and what adds the columns that are told from a row's others: it is asked once rows are in order, so that such columns are not dealt."""

    rows: DataFrame
    finish: Callable[[DataFrame], DataFrame]


class Store:
    """Tables published below a root folder on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str, schemas: Mapping[str, str] = TABLES):
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), dict(schemas)
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._fs.Path("/".join([self.root, *parts]))

    # -- reading -------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        """The numbers of all that was ever published, the oldest first."""
        where = self._path("published")
        fs = where.getFileSystem(self._conf)
        if not fs.exists(where):
            return []
        names = (f.getPath().getName() for f in fs.listStatus(where))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def snapshot(self, number: int | None = None) -> Snapshot:
        """The latest snapshot, or that of a number."""
        if number is None:
            number = max(self.versions(), default=0)
        if not number:
            return Snapshot(0, {t: [] for t in self.schemas}, {})
        where = self._path("published", f"{number:012d}.json")
        stream = where.getFileSystem(self._conf).open(where)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        held = json.loads(text)
        return Snapshot(number, {t: held["folders"].get(t, []) for t in self.schemas}, held["marks"])

    def read(self, table: str, number: int | None = None) -> DataFrame:
        """A table as of the latest snapshot or that of a number; empty before the first."""
        return self.read_folders(table, self.snapshot(number).folders[table])

    def read_folders(self, table: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schemas[table])
        return self.spark.read.schema(self.schemas[table]).parquet(*[f"{self.root}/{f}" for f in folders])

    # -- writing -------------------------------------------------------------------------------

    def write(self, table: str, rows: DataFrame | Unfinished) -> str:
        """Rows in a folder of their own, which belongs to no snapshot until it is published."""
        folder = f"data/{table}-{uuid.uuid4().hex}"
        names = self.spark.createDataFrame([], self.schemas[table]).columns
        out, finish = rows if isinstance(rows, Unfinished) else (rows.select(*names), lambda out: out)
        if order := ORDER.get(table):
            out = out.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
        finish(out).select(*names).write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
        return folder

    def publish(self, base: Snapshot, *, added: Mapping[str, str] | None = None, replaced: Mapping[str, str] | None = None, mark: tuple[str, int] | None = None) -> Snapshot:
        """The next snapshot: the folders of the base, `added` ones behind, `replaced` ones instead. Raises Conflict if the base is
        no longer the latest."""
        folders = {t: list(f) for t, f in base.folders.items()}
        for t, f in (added or {}).items():
            folders[t].append(f)
        for t, f in (replaced or {}).items():
            folders[t] = [f]
        marks = base.marks | ({mark[0]: mark[1]} if mark else {})
        out = Snapshot(base.number + 1, folders, marks)
        self._point(out)
        return out

    def _point(self, snapshot: Snapshot) -> None:
        name = f"{snapshot.number:012d}.json"
        draft, final = self._path("published", f".{name}.{uuid.uuid4().hex}"), self._path("published", name)
        fs = final.getFileSystem(self._conf)
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps({"folders": snapshot.folders, "marks": snapshot.marks}).encode()))
        stream.close()
        none = self.spark.sparkContext._gateway.new_array(getattr(self._fs, "Options$Rename"), 0)
        try:
            self._fs.FileContext.getFileContext(fs.getUri(), self._conf).rename(fs.makeQualified(draft), fs.makeQualified(final), none)
        except Py4JJavaError as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"snapshot {snapshot.number} is there already") from e
            raise

    def compacted(self) -> Snapshot:
        """Each table's folders as one, for readers' sake: many small imports leave many folders."""
        base = self.snapshot()
        many = {t: f for t, f in base.folders.items() if len(f) > 1}
        return self.publish(base, replaced={t: self.write(t, self.read_folders(t, f)) for t, f in many.items()}) if many else base
