"""Ordered series of periods: deltas, baselines, robust scores, gaps, widening windows.

A series is small (one row a period); windows here run over aggregates, never
over rows of the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def over(by: list[str], at: str):
    return Window.partitionBy(*by).orderBy(at)


def log_ratio(df: DataFrame, x: str, at: str, by: list[str] = ()) -> DataFrame:
    before = F.lag(x).over(over(by, at))
    return df.withColumn("log_ratio", F.when((F.col(x) > 0) & (before > 0), F.ln(F.col(x) / before)))


def increments(df: DataFrame, x: str, at: str, by: list[str] = ()) -> DataFrame:
    """Change of a cumulative value, and the change before it."""
    w = over(by, at)
    return df.withColumn("increment", F.col(x) - F.lag(x).over(w)).withColumn("previous_increment", F.lag(x, 1).over(w) - F.lag(x, 2).over(w))


def median_of(a: Column) -> Column:
    """Median of an array (mean of the middle two), NULL for an empty one."""
    s = F.array_sort(a)
    n = F.size(s)
    return F.when(n > 0, (F.element_at(s, ((n + 1) / 2).cast("int")) + F.element_at(s, (n / 2).cast("int") + 1)) / 2)


def robust_z_of(x: Column, history: Column) -> Column:
    """(x - median) / (1.4826 MAD), with the mean absolute deviation where that is 0;
    NULL below three points or without spread."""
    c = median_of(history)
    dev = F.transform(history, lambda v: F.abs(v - c))
    mad = median_of(dev)
    mean = F.aggregate(dev, F.lit(0.0), lambda a, v: a + v) / F.size(dev)
    scale = 1.4826 * F.when(mad > 0, mad).otherwise(mean)
    return F.when((F.size(history) >= 3) & (scale > 0), (x - c) / scale)


def robust_z(df: DataFrame, x: str, at: str, by: list[str] = ()) -> DataFrame:
    """Adds `history` (all earlier finite values) and `z`."""
    w = over(by, at).rowsBetween(Window.unboundedPreceding, -1)
    h = df.withColumn("history", F.collect_list(F.col(x).cast("double")).over(w))
    return h.withColumn("z", robust_z_of(F.col(x).cast("double"), F.col("history")))


def fixed_baseline(df: DataFrame, x: str, at: str, snapshot, by: list[str] = ()) -> DataFrame:
    ref = df.where(F.col(at) == snapshot).select(*by, F.col(x).alias("baseline"))
    return df.join(F.broadcast(ref), list(by), "left") if by else df.crossJoin(F.broadcast(ref))


def trailing_baseline(df: DataFrame, x: str, at: str, n: int, by: list[str] = ()) -> DataFrame:
    """Sum over the n periods before (NULL without any)."""
    return df.withColumn("baseline", F.sum(x).over(over(by, at).rowsBetween(-n, -1)))


def seasonal_baseline(df: DataFrame, x: str, index: str, period: int, cycles: int, by: list[str] = ()) -> DataFrame:
    """Mean of the values 1..cycles seasons ago, by index and not by row."""
    ref = df.select(*by, F.explode(F.transform(F.sequence(F.lit(1), F.lit(cycles)), lambda j: F.col(index) + j * period)).alias(index), F.col(x).alias("__v"))
    ref = ref.groupBy(*by, index).agg(F.avg("__v").alias("baseline"), F.count("__v").alias("cycles"))
    return df.join(ref, [*by, index], "left").withColumn("cycles", F.coalesce("cycles", F.lit(0)))


def gap_spine(df: DataFrame, day: str, by: list[str] = ()) -> DataFrame:
    """Every day between the first and last of all, per series; gaps are rows of NULLs."""
    ends = df.agg(F.min(day).alias("a"), F.max(day).alias("b"))
    days = ends.select(F.explode(F.sequence("a", "b")).alias(day))
    spine = df.select(*by).distinct().crossJoin(F.broadcast(days)) if by else days
    return spine.join(df, [*by, day], "left")


def rollup_levels(df: DataFrame, index: str, sums: list[str], levels: int = 8, factor: int = 2, by: list[str] = ()) -> DataFrame:
    """Windows widening by `factor` a level: each row lands in one window of every level."""
    lv = F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level")
    e = df.select("*", lv).withColumn("window", F.floor(F.col(index) / F.pow(F.lit(factor), F.col("level"))).cast("long"))
    return e.groupBy(*by, "level", "window").agg(*(F.sum(c).alias(c) for c in sums), F.count(F.lit(1)).alias("parts"))


COARSE = FINE = 16


def range_bucket(df: DataFrame, x: str) -> Column:
    """Bucket number of a numeric column, monotone in it and of like row counts.

    The cut points are literals (at most COARSE * FINE quantiles, fetched by one
    aggregate), so the bucket of a row is the same in every evaluation of the plan."""
    n = COARSE * FINE
    cuts = df.agg(F.percentile_approx(F.col(x).cast("double"), [i / n for i in range(1, n)], 10_000).alias("c")).first().c or []
    cuts = sorted(set(cuts))
    if not cuts:
        return F.lit(0)
    groups = [cuts[i : i + FINE] for i in range(0, len(cuts), FINE)]
    below = lambda values: F.size(F.filter(values, lambda c: c < F.col(x)))
    coarse = below(F.array(*(F.lit(float(g[-1])) for g in groups)))
    fine = F.get(F.array(*(F.array(*(F.lit(float(v)) for v in g)) for g in groups)), coarse)
    return coarse * (FINE + 1) + F.coalesce(below(fine), F.lit(0))


def cumulative(h: DataFrame, x: str, n: str, by: list[str] = ()) -> DataFrame:
    """Adds `cum` (running sum of n up to and with x) and `total`, per group of `by`.

    Sums run inside range buckets and are offset by the buckets before, so a group of
    many distinct values is never one task."""
    b = h.withColumn("__b", range_bucket(h, x))
    inside = F.sum(n).over(Window.partitionBy(*by, "__b").orderBy(x))
    sizes = b.groupBy(*by, "__b").agg(F.sum(n).alias("__s"))  # COARSE * (FINE + 1) rows a group at most
    w = Window.partitionBy(*by)
    keys = [F.col(c).alias(f"__k{i}") for i, c in enumerate(by)]
    off = sizes.select(*keys, F.col("__b").alias("__c"), F.coalesce(F.sum("__s").over(w.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"), F.sum("__s").over(w).alias("total"))
    same = F.col("__b") == F.col("__c")
    for i, c in enumerate(by):  # a NULL group is a group
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    j = b.withColumn("__i", inside).join(off, same)
    return j.withColumn("cum", F.col("__i") + F.col("__o")).select(*h.columns, "total", "cum")


def average_rank(df: DataFrame, score: str, by: list[str] = ()) -> DataFrame:
    """Adds `avg_rank` (ties share the mean of their ranks; NULL for a NULL score).

    Ranks come from the counts of distinct scores, so equal scores never meet in one task's buffer."""
    h = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count(F.lit(1)).alias("__n"))
    keys = [F.col(c).alias(f"__r{i}") for i, c in enumerate([*by, score])]
    ranks = cumulative(h, score, "__n", by).select(*keys, (F.col("cum") - F.col("__n") + (F.col("__n") + 1) / 2).alias("avg_rank"))
    same = F.col(score) == F.col(f"__r{len(by)}")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__r{i}"))
    return df.join(ranks, same, "left").select(*df.columns, "avg_rank")


def ecdf_tails(df: DataFrame, x: str, by: list[str] = ()) -> DataFrame:
    """-ln of the left and right empirical tails per distinct value."""
    h = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("n"))
    c = cumulative(h, x, "n", by)
    left, right = F.col("cum") / F.col("total"), (F.col("total") - F.col("cum") + F.col("n")) / F.col("total")
    return c.select(*by, x, "n", (0.0 - F.ln(left)).alias("left_tail"), (0.0 - F.ln(right)).alias("right_tail"))


def ranked(df: DataFrame, score: str, ident: str, cumulate: str | None = None) -> DataFrame:
    """`rank` in descending score with ties by id (and `cum`, the running sum of a column),
    without one global sort task: ranges of scores are ranked apart and offset."""
    b = df.withColumn("__b", range_bucket(df, score))
    w = Window.partitionBy("__b").orderBy(F.desc(score), F.asc(ident))
    b = b.withColumn("__r", F.row_number().over(w))
    sums = [F.count(F.lit(1)).alias("__n")]
    if cumulate:
        b = b.withColumn("__c", F.sum(cumulate).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        sums.append(F.sum(cumulate).alias("__s"))
    before = Window.orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    off = b.groupBy("__b").agg(*sums)
    off = off.select("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"), *([F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__os")] if cumulate else []))
    out = b.join(F.broadcast(off), "__b").withColumn("rank", F.col("__r") + F.col("__o"))
    if cumulate:
        out = out.withColumn("cum", F.col("__c") + F.col("__os"))
    return out.select(*df.columns, "rank", *(["cum"] if cumulate else []))


def sliding_windows(df: DataFrame, x: str, at: str, m: int, by: list[str] = ()) -> DataFrame:
    """Subsequences of length m, by their first position."""
    w = over(by, at).rowsBetween(0, m - 1)
    return df.withColumn("values", F.collect_list(x).over(w)).withColumn("start", F.row_number().over(over(by, at))).where(F.size("values") == m)


def evaluate_deltas(df: DataFrame, delta: str, at: str, threshold: float, by: list[str] = (), alpha_z: float = 2.5758293035489004) -> DataFrame:
    """Every period's delta against the earlier ones: robust z beyond the two-sided 1 %
    point, or with too short a history at least `threshold` and twice the largest before."""
    d = robust_z(df.where(F.col(delta).isNotNull()), delta, at, by)
    x = F.abs(F.col(delta))
    largest = F.array_max(F.transform("history", lambda v: F.abs(v)))
    short = (x >= threshold) & (x >= 2 * largest)
    fired = F.when(F.size("history") == 0, False).when(F.col("z").isNotNull(), F.abs("z") >= alpha_z).otherwise(short)
    return d.withColumn("baseline", median_of(F.col("history"))).withColumn("fired", fired)
