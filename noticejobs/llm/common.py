"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step inside a task works on at a time.
SLICE_BYTES = 2 << 20


def leaves_nothing(run: Callable) -> Callable:
    """Tasks that hold no memory when they are over: a Python worker outlives its task and idles while Spark joins, so what is
    free at its end goes back to the system."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return task


def release_memory() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim is not None:
        trim(0)


def texts(docs: DataFrame, *extra: str) -> DataFrame:
    """``doc_id`` (long) and ``text`` (string) of a table that may have any other columns."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[tuple[list, list]]:
    """Cut a record batch of (doc_id, text, ...) into runs of rows of about ``limit`` bytes of text."""
    ids, column = batch.column(0).to_pylist(), batch.column(1)
    first, size = 0, 0
    for k in range(len(ids)):
        value = column[k]
        size += len(value.as_buffer()) if value.is_valid else 0
        if size >= limit or k + 1 == len(ids):
            yield ids[first : k + 1], column.slice(first, k + 1 - first).to_pylist()
            first, size = k + 1, 0


def arrow_rows(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"  # a single machine, as in tests
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


_tracked: ContextVar[dict | None] = ContextVar("stored tables", default=None)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: later steps survive lost executors."""
    spark, folder = df.sparkSession, shared_folder(df.sparkSession)
    df.write.parquet(folder)
    if (held := _tracked.get()) is not None:
        held[folder] = spark
    out = spark.read.schema(df.schema).parquet(folder)
    out.stored_in = folder
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for table in tables:
        delete(table.sparkSession, table.stored_in)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if (held := _tracked.get()) is not None:
        held.pop(folder, None)


@contextmanager
def tracking() -> Iterator[dict]:
    """The folders of the tables stored (and not deleted) inside, as keys; what is left counts as stored in the block around this one."""
    held: dict = {}
    token = _tracked.set(held)
    try:
        yield held
    finally:
        _tracked.reset(token)
        if (around := _tracked.get()) is not None:
            around.update(held)


def delete_unread(result: DataFrame, held: dict) -> None:
    """Delete the tables of ``held`` that ``result`` does not read."""
    read = {x.rpartition("/")[0] for x in result.inputFiles()} if held else set()
    for folder, spark in list(held.items()):
        if not any(x.endswith(folder.split(":")[-1]) for x in read):
            delete(spark, folder)
            held.pop(folder, None)
