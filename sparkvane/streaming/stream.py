"""Incremental probes as Structured Streaming jobs over a folder of commits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def open_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """One micro-batch per commit file, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def advance(stream: DataFrame, state: Callable[[DataFrame], DataFrame], store: str, checkpoint: str) -> int:
    """Bundles of all commits since the checkpoint, then stops; returns the batches done.

    The bundle of batch n replaces bundle n, so a retried batch leaves one copy. A fresh
    checkpoint makes the same query a backfill; without new files nothing happens."""
    done = []

    def write(batch: DataFrame, n: int) -> None:
        state(batch).withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{store}/bundle={n}")
        done.append(n)

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return len(done)


def merged(spark: SparkSession, store: str, merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Fold of all bundles, equal to the state of all rows at once."""
    return merge(spark.read.parquet(store))


def tumbling(df: DataFrame, ts: str, width: str, aggs: list, late: str | None = None) -> DataFrame:
    d = df.withWatermark(ts, late) if late and df.isStreaming else df
    return d.groupBy(F.window(ts, width)).agg(*aggs)


def sliding(df: DataFrame, ts: str, width: str, step: str, aggs: list, by: list[str] = (), late: str | None = None) -> DataFrame:
    d = df.withWatermark(ts, late) if late and df.isStreaming else df
    return d.groupBy(F.window(ts, width, step), *by).agg(*aggs)


def sessions(df: DataFrame, ts: str, gap: str, by: list[str], aggs: list, late: str | None = None) -> DataFrame:
    d = df.withWatermark(ts, late) if late and df.isStreaming else df
    return d.groupBy(F.session_window(ts, gap), *by).agg(*aggs)


def joined(a: DataFrame, b: DataFrame, key: str, ats: str, bts: str, within: str, late: str = "1 hour") -> DataFrame:
    """Stream-stream join within an interval; both sides carry watermarks so state is dropped."""
    left, right = a.withWatermark(ats, late), b.withWatermark(bts, late)
    return left.join(right, (left[key] == right[key]) & (right[bts] >= left[ats]) & (right[bts] <= left[ats] + F.expr(f"interval {within}")))


def running_counts(df: DataFrame, key: str) -> DataFrame:
    """Arbitrary state: rows seen per key, updated with each batch."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k, frames, state: GroupState):
        import pandas as pd

        n = (state.get[0] if state.exists else 0) + sum(len(f) for f in frames)
        state.update((n,))
        yield pd.DataFrame({key: [k[0]], "seen": [n]})

    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, seen long", "n long", "update", GroupStateTimeout.NoTimeout)
