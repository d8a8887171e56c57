"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable
from itertools import compress, repeat
from operator import is_
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the word and line operators see it.
SPACE = r"\x20\x09-\x0D"


class Recent(dict):
    """A bounded memory: when `most` entries are exceeded, those not asked for since the last such time go."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def __missing__(self, key):
        value = self[key] = self.old[key] if key in self.old else self.make(key)
        return value

    def with_gaps(self, words: list) -> tuple[list, list[int]]:
        """The words' values, None where one is not known or not used lately, and the places of those."""
        values = list(map(self.get, words))
        return values, list(compress(range(len(values)), map(is_, values, repeat(None))))

    def make(self, key):
        raise KeyError(key)

    def has(self, key) -> bool:
        return key in self or key in self.old

    def missing(self, lists) -> list:
        """The distinct members of the lists that are not known."""
        old = self.old
        return [w for w in set().union(*lists) if w not in self and w not in old]

    def trim(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


_HELD: dict = {}


def held(key: tuple, make: Callable[[], Any]) -> Any:
    """The model of this key, made once in a Python process, which lets go of the one before, of another operator or file."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def give_back() -> None:
    """Memory that Arrow and the C library keep for later goes back to the system: a worker's next operator may want it elsewhere."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def let_go() -> None:
    """The model that is held goes: for operators that have none, before they take memory."""
    if _HELD:
        _HELD.clear()
        give_back()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where it is unset, a fresh one of our own if all
    tasks run in this process; on a cluster that would be a folder of one machine, so it is an error."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder is None:
        folder = sc.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call gets."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs nothing that was done before."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(stem: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, in any case."""
    taken = {c.lower() for f in frames for c in f.columns}
    name = f"_{stem}"
    while name in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def utf8_length(text: Column) -> Column:
    """Bytes of the text in UTF-8; 0 if null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def seeded_key(seed: str, *columns: str) -> Column:
    """A hash-random key of the named columns: 32 lowercase hex digits, the same on every run and in any SQL engine."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def key_bucket(key: Column, buckets: int) -> Column:
    """The key's place among equal ranges of the key space, in the order of the keys; buckets is a power of 16."""
    digits = 0
    while 16**digits < buckets:
        digits += 1
    return F.conv(F.concat(F.lit("0"), F.substring(key, 1, digits)), 16, 10).cast("long") if digits else F.lit(0).cast("long")


def pieces_for(rows: int, rows_each: int = 100_000) -> int:
    """Partitions for a narrow table of so many rows: a small one in many pieces costs more in files and tasks than in work."""
    return max(1, -(-rows // rows_each))


def buckets_for(rows: int, rows_each: int = 20_000) -> int:
    """A power of 16, so that a bucket of hash-random keys holds about rows_each rows at most."""
    n = 1
    while n * rows_each < rows:
        n *= 16
    return n
