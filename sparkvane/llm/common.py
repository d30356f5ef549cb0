"""Shared helpers: table reads, durable intermediate tables, edge cases."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Batches of at most BATCH_BYTES from the JVM to Python in this session (64 MB by default):
    an executor's memory is then its heap and small buffers, whatever the rows' sizes."""
    if int(spark.conf.get(BATCH).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset a temporary one, on one machine only."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="sparkvane-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d


def durable(df: DataFrame, **options: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends there, so
    a lost executor costs a re-read, never a recomputation. options: of the Parquet writer."""
    small_batches(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/t-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(df: DataFrame, id_col: str, text_col: str, null_text: str | None = "") -> DataFrame:
    """Only the two columns used, renamed, so that extra or clashing columns are harmless."""
    small_batches(df.sparkSession)
    t = F.col(text_col).cast("string")
    if null_text is not None:
        t = F.coalesce(t, F.lit(null_text))
    return df.select(F.col(id_col).alias("doc_id"), t.alias("text"))


def id_crc(col: Column | str) -> Column:
    """crc32 of the id written as decimal text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(c.cast("string").cast("binary"))


def is_fold(col: Column | str, mod: int, which: int = 1) -> Column:
    """True where crc32(id) mod `mod` is `which`; a null id is never held out."""
    return F.coalesce(id_crc(col) % mod == which, F.lit(False))


def slices(batch, max_bytes: int = 8 << 20, col: str = "text"):
    """Cut an Arrow batch into runs of at most `max_bytes` of text (one row at least)."""
    import numpy as np
    import pyarrow as pa

    arr = batch.column(batch.schema.get_field_index(col))
    if pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.string())
    elif pa.types.is_large_binary(arr.type):
        arr = arr.cast(pa.binary())
    off = np.frombuffer(arr.buffers()[1], dtype=np.int32, count=len(arr) + 1 + arr.offset)[arr.offset :] if len(arr) else np.zeros(1, np.int32)
    i, n = 0, len(arr)
    while i < n:
        j = int(np.searchsorted(off, off[i] + max_bytes, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield batch.slice(i, j - i)
        i = j
    trim()


def trim() -> None:
    """Give freed pages back: a worker serves many tasks, and what one stage's arrays
    took would otherwise stay resident through the next ones."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass
