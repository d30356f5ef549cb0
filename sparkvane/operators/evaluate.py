"""Scores of predictions and discoveries.

Rank metrics work on counts per distinct score, so a window never orders more
rows than there are scores; ties share ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .series import cumulative, ranked


def _by_score(df: DataFrame, y: str, s: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by, s).agg(F.sum(y).alias("p"), F.count(F.lit(1)).alias("n"))


def roc_auc(df: DataFrame, y: str, s: str, by: list[str] = ()) -> DataFrame:
    """NULL with one class only."""
    h = cumulative(_by_score(df, y, s, by), s, "n", by)
    below = F.col("cum") - F.col("n")
    h = h.withColumn("r", (below + (F.col("n") + 1) / 2) * F.col("p"))
    p, n = F.sum("p"), F.sum("n")
    return h.groupBy(*by).agg(n.alias("n"), p.alias("positives"), F.try_divide(F.sum("r") - p * (p + 1) / 2, p * (n - p)).alias("auc"))


def average_precision(df: DataFrame, y: str, s: str, ident: str) -> DataFrame:
    """Step-wise, in descending score with ties by id.

    The order is global; it is cut into score ranges, ranked inside, and offset by the
    counts of the ranges before."""
    d = ranked(df.select(y, s, ident), s, ident, cumulate=y)
    a = F.sum(F.when(F.col(y) == 1, F.col("cum") / F.col("rank")))
    return d.agg(F.try_divide(a, F.sum(y)).alias("average_precision"))


def at_k(df: DataFrame, y: str, s: str, ident: str, ks: list[int]) -> DataFrame:
    """precision and recall of the k best, ties by id; only the largest k rows are ordered."""
    total = df.agg(F.sum(y).alias("all"))
    top = df.orderBy(F.desc(s), F.asc(ident)).limit(max(ks)).withColumn("r", F.row_number().over(Window.orderBy(F.desc(s), F.asc(ident))))
    k = F.explode(F.array(*map(F.lit, ks))).alias("k")
    t = top.select(y, "r", k).where("r <= k").groupBy("k").agg(F.sum(y).alias("hits"), F.count(F.lit(1)).alias("taken"))
    return t.crossJoin(F.broadcast(total)).select("k", (F.col("hits") / F.col("taken")).alias("precision"), F.try_divide("hits", "all").alias("recall"))


def brier(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"), F.avg(y).alias("positive_rate"))


def ece(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    b = df.groupBy(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("conf"), F.avg(y).alias("rate"))
    return b.agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("rate"))) / F.sum("n")).alias("ece"))


def bootstrap_auc(df: DataFrame, y: str, s: str, ident: str, resamples: int = 200, seed: int = 7) -> DataFrame:
    """Percentile interval of the AUC with Poisson(1) weights that a hash of (seed, round, id) draws."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "b", ident), 11).cast("double") + 0.5) / float(1 << 53)
    cuts = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    weight = sum(((u > c).cast("int") for c in cuts), F.lit(0))
    e = df.select(y, s, ident, F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("b")).withColumn("w", weight).where("w > 0")
    h = e.groupBy("b", s).agg(F.sum(F.col("w") * F.col(y)).alias("p"), F.sum("w").alias("n"))
    below = F.sum("n").over(Window.partitionBy("b").orderBy(s)) - F.col("n")
    h = h.withColumn("r", (below + (F.col("n") + 1) / 2) * F.col("p"))
    p, n = F.sum("p"), F.sum("n")
    a = h.groupBy("b").agg(F.try_divide(F.sum("r") - p * (p + 1) / 2, p * (n - p)).alias("auc"))
    return a.agg(F.percentile("auc", [0.025, 0.975]).alias("q")).select(F.element_at("q", 1).alias("low"), F.element_at("q", 2).alias("high"))


def sliced_auc(df: DataFrame, y: str, s: str, by: str, k: int = 20) -> DataFrame:
    """AUC per slice, blank for small cells."""
    a = roc_auc(df, y, s, [by])
    return a.withColumn("auc", F.when(F.col("n") >= k, F.col("auc")))


def discovery_score(found: DataFrame, truth: DataFrame, ks=(10, 25, 50, 100)) -> DataFrame:
    """found: fingerprint, rank, surfaced (step); truth: fingerprint, onset (step)."""
    j = found.join(truth, "fingerprint", "left").withColumn("hit", F.col("onset").isNotNull().cast("int"))
    parts = [F.avg(F.when(F.col("rank") <= k, F.col("hit"))).alias(f"precision_at_{k}") for k in ks]
    return j.agg(*parts, F.percentile(F.when(F.col("hit") == 1, F.col("surfaced") - F.col("onset")), F.lit(0.5)).alias("median_delay"), F.count_distinct(F.when(F.col("hit") == 1, F.col("fingerprint"))).alias("distinct_found"))


def champion_challenger(a: DataFrame, b: DataFrame, ident: str, rank: str = "rank") -> DataFrame:
    """gained, lost, moved or same per finding of two ranked lists."""
    x, y = a.select(ident, F.col(rank).alias("old_rank")), b.select(ident, F.col(rank).alias("new_rank"))
    j = x.join(y, ident, "full")
    change = F.when(F.col("old_rank").isNull(), "gained").when(F.col("new_rank").isNull(), "lost").when(F.col("old_rank") != F.col("new_rank"), "moved").otherwise("same")
    return j.withColumn("change", change)


def recurrence(findings: DataFrame, fingerprint: str, step: str, score: str) -> DataFrame:
    """Steps, first sight and best score of equal findings."""
    return findings.groupBy(fingerprint).agg(F.count_distinct(step).alias("steps"), F.min(step).alias("first_surfaced"), F.max(score).alias("best_score"))


def leaks(df: DataFrame, cols: list[str], forbidden: list[str]) -> DataFrame:
    """Rows in which a forbidden string stands in any column (a bounded list, as literals)."""
    hit = [F.when(F.contains(F.col(c).cast("string"), F.lit(x)), F.struct(F.lit(c).alias("column"), F.lit(x).alias("value"))) for c in cols for x in forbidden]
    return df.select("*", F.explode(F.array_compact(F.array(*hit))).alias("leak")).select(*df.columns, "leak.column", "leak.value")


def fit_baseline(train: DataFrame, test: DataFrame, features: list[str], label: str):
    """Gradient-boosted trees of the ML library over a small grid; held-out AUC by grid point."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler

    va = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="keep")
    ev = BinaryClassificationEvaluator(labelCol=label)
    out = []
    for depth in (3, 5):
        for rounds in (10, 20):
            m = GBTClassifier(featuresCol="__x", labelCol=label, maxDepth=depth, maxIter=rounds, seed=1).fit(va.transform(train))
            out.append((depth, rounds, ev.evaluate(m.transform(va.transform(test)))))
    return out
