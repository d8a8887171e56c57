"""The folder that driver and executors share, for tables that a job writes on its way."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder of this machine if all tasks run here; on a cluster that is an error."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="ledgers-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else gets."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder: loops start each round from there, and a lost executor takes nothing along."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, path: str) -> DataFrame:
    """df computed once and kept as a table at the path: some tenth of a checkpoint's size, of which readers take the columns that they need.
    It stays until it is discarded."""
    void = [f.name for f in df.schema if isinstance(f.dataType, NullType)]
    kept = df.drop(*void)
    kept.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(kept.schema).parquet(path).withColumns({c: F.lit(None) for c in void})


def discard(spark: SparkSession, path: str) -> None:
    """A folder that `stored` tables are in goes, if it is there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
