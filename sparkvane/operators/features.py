"""Point-in-time features, as-of labels, splits and encodings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import micros

SECOND = 1_000_000


@dataclass(frozen=True)
class Rule:
    """History in [t - lookback, t - embargo), or up to and with t - embargo."""

    lookback: int  # microseconds
    embargo: int = 0
    inclusive_end: bool = False

    def __post_init__(self) -> None:
        if not 0 <= self.embargo < self.lookback:
            raise ValueError("0 <= embargo < lookback is needed")


def pit_self(df: DataFrame, entity: str, ts: str, agg: Column, rule: Rule, name: str = "value", fill_zero: bool = False) -> DataFrame:
    """`agg` over an entity's own earlier rows, strictly by time.

    Rows are cut into lookback-wide buckets of an entity, each with a copy of the bucket
    before it, so a window sorts two lookbacks of an entity and never all of a hot one.
    A row without a time has the other such rows of its entity as history."""
    end = -rule.embargo if rule.inclusive_end else -rule.embargo - 1
    bucket = F.floor(micros(ts) / rule.lookback)
    copies = F.when(bucket.isNull(), F.array(bucket)).otherwise(F.array(bucket, bucket + 1))
    d = df.withColumn("__b", F.explode(copies))
    w = Window.partitionBy(entity, "__b").orderBy(micros(ts)).rangeBetween(-rule.lookback, end)
    v = agg.over(w)
    d = d.withColumn(name, F.coalesce(v, F.lit(0)) if fill_zero else v)
    return d.where(F.col("__b").eqNullSafe(bucket)).drop("__b")


def pit_join(events: DataFrame, history: DataFrame, entity: str, ts: str, hts: str, agg: Column, rule: Rule, ident: str, name: str = "value", fill_zero: bool = False) -> DataFrame:
    """`agg` over another table's rows of the entity in the window of each event.

    Both sides are cut into lookback-wide buckets; an event meets its own bucket and the
    one before, so the equi-join key (entity, bucket) bounds fan-out and spreads hot
    entities over time. Events without history keep a row."""
    e = events.select(ident, entity, micros(ts).alias("__t")).withColumn("__b", F.explode(F.array(F.floor(F.col("__t") / rule.lookback), F.floor(F.col("__t") / rule.lookback) - 1)))
    h = history.withColumn("__h", micros(hts)).withColumn("__b", F.floor(F.col("__h") / rule.lookback))
    h = h.withColumnRenamed(entity, "__e").drop(ident)
    last = F.col("__t") - rule.embargo
    inside = (F.col("__h") >= F.col("__t") - rule.lookback) & ((F.col("__h") <= last) if rule.inclusive_end else (F.col("__h") < last))
    j = e.join(h, (e[entity] == h["__e"]) & (e["__b"] == h["__b"]) & inside)
    v = j.groupBy(ident).agg(agg.alias(name))
    out = events.join(v, ident, "left")
    return out.withColumn(name, F.coalesce(name, F.lit(0))) if fill_zero else out


def as_of_labels(labels: DataFrame, instant, entity: str, label_time: str, ident: str) -> DataFrame:
    """Newest label of each entity that was known at `instant`, without sorting a whole entity."""
    seen = labels.where(F.col(label_time) <= instant)
    cols = [c for c in labels.columns if c != entity]
    best = F.max_by(F.struct(*cols), F.struct(label_time, ident)).alias("__l")
    return seen.groupBy(entity).agg(best).select(entity, *(F.col(f"__l.{c}").alias(c) for c in cols))


def coverage(decl: DataFrame, start, end, lo: str = "starts", hi: str = "ends") -> DataFrame:
    """Whether a single declaration spans the window."""
    return decl.agg(F.coalesce(F.bool_or((F.col(lo) <= start) & (F.col(hi) >= end)), F.lit(False)).alias("covered"))


def temporal_split(df: DataFrame, ts: str, eval_share: float, embargo: int = 0) -> DataFrame:
    """Adds `part`: train before the cut-off quantile, eval from it (after the embargo)."""
    n = df.agg(F.expr(f"percentile_disc({1 - eval_share}) within group (order by unix_micros(cast(`{ts}` as timestamp)))").alias("__cut"))
    t = micros(ts)
    part = F.when(t < F.col("__cut"), "train").when(t >= F.col("__cut") + embargo, "eval").otherwise("embargo")
    return df.crossJoin(F.broadcast(n)).withColumn("part", part).drop("__cut")


def mask_split(df: DataFrame, ident: str, share: float, seed: int) -> DataFrame:
    """Adds `hidden`: a hash of (seed, id) hides about `share` of the labels, the same ones on every run."""
    return df.withColumn("hidden", F.pmod(F.xxhash64(F.lit(seed), ident), F.lit(1_000_000)) < int(share * 1_000_000))


def pattern_indicator(df: DataFrame, segment, name: str) -> DataFrame:
    return df.withColumn(name, F.coalesce(segment.expr(), F.lit(False)).cast("int"))


def residual(df: DataFrame, label: str, score: str, name: str = "residual") -> DataFrame:
    return df.withColumn(name, F.col(label) - F.col(score))


_AGGREGATES = {"count", "sum", "avg", "min", "max", "stddev_samp", "var_samp", "count_distinct", "max_by", "min_by"}


def feature_aggregate(fn: str, *cols: str) -> Column:
    """The whitelist of feature aggregates, by name over columns only."""
    if fn not in _AGGREGATES or not cols:
        raise ValueError(f"{fn} is no feature aggregate")
    return getattr(F, fn)(*cols)


def with_label_delay(df: DataFrame, event_time: str, delay: Column | str, name: str = "label_time") -> DataFrame:
    """Label time from the event time and a declared delay (an interval column or its text)."""
    d = F.expr(f"interval {delay}") if isinstance(delay, str) else delay
    return df.withColumn(name, F.col(event_time) + d)


def design_matrix(df: DataFrame, ident: str, numeric: list[str], categorical: list[str], limit: int = 512) -> DataFrame:
    """Doubles for numbers, category shares for categories of at most `limit` values."""
    from .aggregates import frequency_encoding

    for c in categorical:
        df = frequency_encoding(df, c, limit)
    return df.select(ident, *(F.col(c).cast("double").alias(c) for c in numeric), *(F.col(f"{c}_share") for c in categorical))


def graph_feature(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Out-degree and in-degree of every entity of a graph."""
    out = edges.groupBy(F.col(source).alias("entity")).agg(F.count(F.lit(1)).alias("out_degree"))
    into = edges.groupBy(F.col(target).alias("entity")).agg(F.count(F.lit(1)).alias("in_degree"))
    return out.join(into, "entity", "full").na.fill(0, ["out_degree", "in_degree"])
