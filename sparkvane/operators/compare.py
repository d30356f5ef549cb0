"""Histogram alignment and comparison: G, PSI, Jensen-Shannon, Wasserstein, dispersion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def align(now: DataFrame, ref: DataFrame, keys: list[str], by: list[str] = ()) -> DataFrame:
    """Full outer join of two histograms (.., n) as n1 and n0; a missing bin counts 0."""
    on = [*by, *keys]
    a = now.select(*on, F.col("n").alias("n1"))
    b = ref.select(*on, F.col("n").alias("n0"))
    return a.join(b, on, "full").na.fill(0, ["n1", "n0"])


def with_totals(h: DataFrame, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by)
    return h.withColumns({"t1": F.sum("n1").over(w), "t0": F.sum("n0").over(w), "bins": F.count(F.lit(1)).over(w)})


def terms(n1: Column, n0: Column, t1: Column, t0: Column, bins: Column) -> dict[str, Column]:
    """Per-bin parts of PSI (0.5 smoothing), JS in bits and G."""
    p, q = F.coalesce(F.try_divide(n1, t1), F.lit(0.0)), F.coalesce(F.try_divide(n0, t0), F.lit(0.0))
    m = (p + q) / 2
    sp, sq = (n1 + 0.5) / (t1 + 0.5 * bins), (n0 + 0.5) / (t0 + 0.5 * bins)
    pool = F.try_divide(n1 + n0, t1 + t0)
    half = lambda x: F.when(x > 0, x / 2 * F.log2(x / m)).otherwise(0.0)
    g = lambda n, x: F.when(n > 0, n * F.ln(x / pool)).otherwise(0.0)
    return {"psi": (sp - sq) * F.ln(sp / sq), "js": half(p) + half(q), "g": 2 * (g(n1, p) + g(n0, q))}


def collapse_unordered(h: DataFrame, key: str, by: list[str], least: float = 5.0) -> DataFrame:
    """Bins with min(t1, t0) * pooled share below `least` become one bin OTHER."""
    t = with_totals(h, by)
    expected = F.least("t1", "t0") * (F.col("n1") + F.col("n0")) / (F.col("t1") + F.col("t0"))
    name = F.when(expected >= least, F.col(key).cast("string")).otherwise("OTHER")
    return t.groupBy(*by, name.alias(key)).agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def collapse_ordered(bins: list[tuple[float, float]], least: float = 5.0) -> list[tuple[float, float]]:
    """Adjacent (n1, n0) added up until expected counts reach `least`; a small rest joins the last.
    For the few bins of one comparison, on the driver."""
    t1, t0 = sum(a for a, _ in bins), sum(b for _, b in bins)
    out, a1, a0 = [], 0.0, 0.0
    for n1, n0 in bins:
        a1, a0 = a1 + n1, a0 + n0
        if t1 + t0 and min(t1, t0) * (a1 + a0) / (t1 + t0) >= least:
            out.append((a1, a0))
            a1 = a0 = 0.0
    if a1 or a0:
        if out:
            out[-1] = (out[-1][0] + a1, out[-1][1] + a0)
        else:
            out.append((a1, a0))
    return out


def compare(h: DataFrame, by: list[str]) -> DataFrame:
    """One row per comparison: n1, n0, bins, df, psi, psi_chi, js_bits, g.

    h: by.., bin key, n1, n0. Collapse sparse bins first where a test follows."""
    t = with_totals(h, by)
    x = terms(*(F.col(c) for c in ("n1", "n0", "t1", "t0", "bins")))
    a = t.groupBy(*by).agg(F.max("t1").alias("n1"), F.max("t0").alias("n0"), F.max("bins").alias("bins"), F.sum(x["psi"]).alias("psi"), F.sum(x["js"]).alias("js_bits"), F.sum(x["g"]).alias("g"))
    a = a.withColumn("df", F.greatest(F.col("bins") - 1, F.lit(0)))
    return a.withColumn("psi_chi", F.try_divide(F.col("psi") * F.col("n1") * F.col("n0"), F.col("n1") + F.col("n0")))


def attribution(h: DataFrame, key: str, by: list[str], top: int = 3) -> DataFrame:
    """The bins that carry most of a JS divergence, with their share of it."""
    t = with_totals(h, by)
    js = terms(*(F.col(c) for c in ("n1", "n0", "t1", "t0", "bins")))["js"]
    t = t.withColumn("term", js).withColumn("share", F.try_divide(F.col("term"), F.sum("term").over(Window.partitionBy(*by))))
    r = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("term"), key))
    return t.withColumn("rank", r).where(F.col("rank") <= top).select(*by, key, "rank", "share", (F.col("n1") / F.col("t1") - F.col("n0") / F.col("t0")).alias("shift"))


def wasserstein(h: DataFrame, edge: str, by: list[str]) -> DataFrame:
    """W1, its signed form and the largest gap of two CDFs over common edges.

    h: by.., edge (upper end of the bin; NULL for the last, open bin), n1, n0."""
    t = with_totals(h, by)
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_last(edge))
    t = t.withColumn("gap", F.sum("n0").over(w) / F.col("t0") - F.sum("n1").over(w) / F.col("t1")).withColumn("width", F.lead(edge).over(w) - F.col(edge))
    t = t.where(F.col(edge).isNotNull())
    return t.groupBy(*by).agg(
        F.max("t1").alias("n1"), F.max("t0").alias("n0"), F.max(F.abs("gap")).alias("ks"),
        F.coalesce(F.sum(F.abs("gap") * F.col("width")), F.lit(0.0)).alias("w1"), F.coalesce(F.sum(F.col("gap") * F.col("width")), F.lit(0.0)).alias("signed_w1"),
    )


def shares_shape(h: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """HHI with its variance, Gini and the top share of a histogram.

    Keys of equal count are taken together, so what a window orders is the distinct counts."""
    c = h.groupBy(*by, F.col(n).alias("__n")).agg(F.count(F.lit(1)).alias("__m"))
    w = Window.partitionBy(*by)
    t = c.withColumns({"__t": F.sum(F.col("__n") * F.col("__m")).over(w), "__k": F.sum("__m").over(w), "__b": F.sum("__m").over(w.orderBy("__n")) - F.col("__m")})
    s = F.col("__n") / F.col("__t")
    s2, s3 = F.sum(F.col("__m") * s * s), F.sum(F.col("__m") * s * s * s)
    pairs = F.sum(F.col("__n") * F.col("__m") * (2 * F.col("__b") + F.col("__m") - F.col("__k")))
    return t.groupBy(*by).agg(F.max("__t").alias("total"), s2.alias("hhi"), (4 / F.max("__t") * (s3 - s2 * s2)).alias("hhi_variance"), (pairs / (F.max("__k") * F.max("__t"))).alias("gini"), F.max(s).alias("top1_share"))
