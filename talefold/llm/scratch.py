"""Intermediate tables that cut a job's lineage and survive lost executors."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow table (keys and a few numbers) may be broadcast.
BROADCAST_ROWS = 200_000


@functools.cache
def _own(application: str) -> str:
    """A temporary folder of a local application."""
    return tempfile.mkdtemp(prefix="spark-")


def folder(spark: SparkSession) -> str:
    """A new folder under `spark.checkpoint.dir`, which all executors share.

    Where the setting is absent, a temporary folder is used if and only if the
    driver and the executors are one process; a cluster has to name a folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own(spark.sparkContext.applicationId)
    return f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes df once and returns the written table."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to hold at most `rows` rows, else df.

    A full count, as a limit would bring rows of every partition to one task.
    """
    return F.broadcast(df) if df.count() <= rows else df


def parts(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Parts of Arrow batches, so that Python objects are made for a few rows at a time; at
    the end of a task its worker, which may stay for other tasks, gives unused memory back."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
        del batch
    pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
