"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perfengine.session import ensure_checkpoint_dir, ship

#: Sides up to so many bytes may be broadcast; beyond it joins shuffle.
BROADCAST_BYTES = 8 << 20
#: Rows and bytes of one Arrow batch handed to Python, which bound a task's memory.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded rows and bytes, so that long texts do not pile up in a worker."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, giving freed memory back to the system when a task ends: Python workers outlive their tasks."""
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)
    return wrapped


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder; Hadoop deletes it when the driver ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).deleteOnExit(at)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows written to a shared folder and read back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def set_aside(docs: DataFrame, taken: set[str]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with the columns named like one of ``taken`` (in any case) renamed to ``<name>_in``, and the columns that restore it."""
    used, names = {c.lower() for c in [*docs.columns, *taken]}, {}
    for c in docs.columns:
        if c.lower() in {t.lower() for t in taken}:
            name = f"{c}_in"
            while name.lower() in used:
                name += "_"
            used.add(name.lower())
            names[c] = name
    return docs.withColumnsRenamed(names), [F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns]


def fits_broadcast(df: DataFrame, row_bytes: int) -> bool:
    """Whether the rows of a (saved) table, at ``row_bytes`` each, are few enough to broadcast."""
    return df.count() * row_bytes <= BROADCAST_BYTES


def small_side(df: DataFrame, row_bytes: int) -> DataFrame:
    """The table with a broadcast hint if its size allows it; else as it is, for a shuffle join."""
    return F.broadcast(df) if fits_broadcast(df, row_bytes) else df
