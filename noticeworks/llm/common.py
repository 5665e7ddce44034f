"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only where it is unset and all runs on one machine (tests, a laptop) a temporary folder takes its place.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='noticeworks-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return re.sub(r"^file:/(?!/)", "file:///", folder).rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/noticeworks/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, narrow: bool = False, compression: str | None = None) -> DataFrame:
    """Cuts the lineage: writes df as a table in the shared folder and reads that.

    narrow: rows are a few numbers each, so an eighth of the usual partitions is enough.  Not for rows that are dear to make:
    the tasks that make them are as many less.  compression: of Parquet, where rows are large.
    """
    path = fresh_path(df.sparkSession, name)
    if narrow:
        df = df.coalesce(max(4, shuffle_partitions(df.sparkSession) // 8))
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Gives back what a Python worker has freed: workers outlive their tasks, and C's allocator keeps freed texts and arrays for itself."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


class Growing:
    """A table in the shared folder that rows are added to: one scan, however often it has grown."""

    def __init__(self, spark: SparkSession, name: str, schema: str):
        self.spark, self.schema, self.path = spark, schema, fresh_path(spark, name)

    def add(self, df: DataFrame) -> None:
        df.coalesce(max(4, shuffle_partitions(self.spark) // 8)).write.mode("append").parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
