"""Shared pieces of the operators: written tables, distinct texts, Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import cut as written
from ..functions.shared import drop, new_path


_caches: list[dict] = []


def worker_cache() -> dict:
    """A dictionary that a Python worker keeps between tasks of the same kind."""
    _caches.append({})
    return _caches[-1]


def fresh_worker() -> None:
    """Give back what earlier tasks have left in this worker: it lives on, and memory is shared by all.

    What is kept for tasks of another kind goes, and so do freed pages that the allocators hold, whoever has used them.
    """
    if any(_caches):
        for held in _caches:
            held.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of at most ``rows`` rows, where the session does not say otherwise: rows are texts, and a batch is in
    memory several times, in the JVM and in the worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(rows))


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_key(text: str = "text"):
    """128-bit identity of a text (null counts as empty), as 16 bytes."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def distinct_texts(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    """Each different text once: ``key`` (text_key), ``body`` (UTF-8 bytes), ``copies`` (rows that hold it).

    Written as a table bucketed by ``key`` in the shared folder, so later joins by ``key`` move no text.
    Copies meet in map-side combines first, so a text that a third of the rows share is no hot key.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select(text_key(text).alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    found = rows.groupBy("key").agg(F.first("body").alias("body"), F.count(F.lit(1)).alias("copies"))
    table = f"{name}_{uuid.uuid4().hex}"
    path = new_path(spark, name)
    found.repartition(n, "key").write.bucketBy(n, "key").sortBy("key").format("parquet").option("path", path).saveAsTable(table)
    out = spark.table(table)
    out._texlake_path, out._texlake_table = path, table
    return out


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary Arrow column, and the offsets of its values in them (nulls are empty)."""
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, at - at[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of values of at most ``most`` bytes together; a larger value stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def batches_of(batch: pa.RecordBatch, column: str, most: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of an Arrow batch with the bytes and offsets of ``column``, bounded so that work arrays stay small."""
    flat, offsets = flat_bytes(batch.column(column))
    for i, j in slices(offsets, most):
        yield batch.slice(i, j - i), flat[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def list_column(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from concatenated values and the length of each list."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values, kind))


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
