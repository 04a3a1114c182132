"""Helpers shared by the operators: tables, folds, chunks of long texts, saved results."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from debtscope.session import scratch

#: Longest stretch of characters that is expanded into arrays at once.
CHUNK = 1 << 20

_SPACE = re.compile(r"\s")

#: One batch that goes to Python; texts of any length then keep a worker's memory bounded.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


#: Bytes of a batch where many steps share their workers and executors, which keep the buffers of the largest batches.
SMALL_BATCH = 2 << 20


def batched(spark: SparkSession, size: int | None = None) -> SparkSession:
    """Bound the Arrow batches of a session by rows and by bytes, ``size`` of them if given."""
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    if size is not None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return batched(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: Column, modulus: int) -> Column:
    """CRC-32 of a key as text, modulo ``modulus``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def held_out(key: Column, modulus: int, value: int) -> Column:
    """Whether a row belongs to the held-out fold; rows without a key do, as nothing is learned from them."""
    return F.coalesce(remainder(key, modulus) == value, F.lit(True))


def trim() -> None:
    """Give freed memory of a worker back to its machine; workers live on and serve the next stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """Cut a text behind white space into stretches of about ``size`` characters; a longer run without white space stays whole."""
    start = 0
    while len(text) - start > size:
        cut = _SPACE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.end()]
        start = cut.end()
    yield text[start:]


def saved(rows: DataFrame) -> DataFrame:
    """Cut lineage: write the rows once and read them back, so that later steps survive lost executors.

    The files are Parquet in the shared folder, so that a later step reads only the columns it
    needs.  They may be deleted once the result has been written; :func:`forget` does that.
    """
    spark = rows.sparkSession
    path = scratch(spark)
    rows.write.parquet(path)
    _SAVED.append(path)
    return spark.read.schema(rows.schema).parquet(path)


_SAVED: list[str] = []


def forget(spark: SparkSession) -> None:
    """Delete what :func:`saved` has written so far in this session's driver."""
    context = spark.sparkContext
    while _SAVED:
        path = context._jvm.org.apache.hadoop.fs.Path(_SAVED.pop())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
