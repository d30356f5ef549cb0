"""Exact aggregates and their mergeable states; sketches as named variants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite
from .compare import shares_shape


def null_rate(df: DataFrame, cols: list[str], by: list[str] = ()) -> DataFrame:
    """Long form (by.., column, nulls, total, rate); one scan for all columns."""
    a = df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *(F.count(c).alias(f"__{c}") for c in cols))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), (F.col("total") - F.col(f"__{c}")).alias("nulls")) for c in cols)))
    return a.select(*by, "total", rows.alias("r")).select(*by, "r.column", "r.nulls", "total", F.try_divide("r.nulls", "total").alias("rate"))


def moment_columns(c: str) -> list[Column]:
    """n, mean, variance, sd, skewness, excess kurtosis, cv, min, max, sum, sum of squares, nonfinite."""
    x = finite(c)
    n, mean, sd = F.count(x), F.avg(x), F.stddev_samp(x)
    return [
        n.alias("n"), mean.alias("mean"), F.var_samp(x).alias("variance"), sd.alias("sd"), F.when(n >= 3, F.skewness(x)).alias("skewness"), F.when(n >= 4, F.kurtosis(x)).alias("kurtosis"),
        F.try_divide(sd, F.abs(mean)).alias("cv"), F.min(x).alias("min"), F.max(x).alias("max"), F.sum(x).alias("sum"), F.sum(x * x).alias("sum_sq"),
        (F.count(c) - n).alias("nonfinite"),
    ]


def moments(df: DataFrame, c: str, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*moment_columns(c))


def moment_state(df: DataFrame, c: str, by: list[str], centre: float) -> DataFrame:
    """Mergeable power sums about a fixed centre (n, s1..s4, min, max): merging is `sum`."""
    x = finite(c) - centre
    return df.groupBy(*by).agg(F.count(x).alias("n"), *(F.sum(F.pow(x, p)).alias(f"s{p}") for p in (1, 2, 3, 4)), F.min(finite(c)).alias("min"), F.max(finite(c)).alias("max"))


def merge_moment_states(states: DataFrame, by: list[str] = ()) -> DataFrame:
    return states.groupBy(*by).agg(*(F.sum(x).alias(x) for x in ("n", "s1", "s2", "s3", "s4")), F.min("min").alias("min"), F.max("max").alias("max"))


def finish_moment_state(states: DataFrame, centre: float) -> DataFrame:
    n, m = F.col("n"), F.col("s1") / F.col("n")
    m2 = F.col("s2") - n * m * m
    m3 = F.col("s3") - 3 * m * F.col("s2") + 2 * n * m**3
    m4 = F.col("s4") - 4 * m * F.col("s3") + 6 * m * m * F.col("s2") - 3 * n * m**4
    return states.select(
        *(c for c in states.columns if c not in ("s1", "s2", "s3", "s4")),
        (m + centre).alias("mean"), F.when(n > 1, m2 / (n - 1)).alias("variance"), F.try_divide(F.sqrt(n) * m3, F.pow(m2, 1.5)).alias("skewness"), (F.try_divide(n * m4, m2 * m2) - 3).alias("kurtosis"),
    )


def quantiles(df: DataFrame, c: str, fractions: list[float], by: list[str] = (), discrete: bool = False) -> DataFrame:
    """Long form (by.., fraction, value): interpolating, or the least value reaching the fraction."""
    if discrete:
        agg = [F.expr(f"percentile_disc({f}) within group (order by `{c}`)").alias(f"__{i}") for i, f in enumerate(fractions)]
        rows = F.array(*(F.struct(F.lit(f).alias("fraction"), F.col(f"__{i}").alias("value")) for i, f in enumerate(fractions)))
    else:
        agg = [F.percentile(c, [float(f) for f in fractions]).alias("__q")]
        rows = F.zip_with(F.array(*map(F.lit, fractions)), F.col("__q"), lambda f, v: F.struct(f.alias("fraction"), v.alias("value")))
    return df.groupBy(*by).agg(*agg).select(*by, F.inline(rows))


def bin_index(c, edges: list[float]) -> Column:
    """Bin of (edge i-1, edge i]: the number of edges below the value."""
    return F.aggregate(F.array(*map(F.lit, edges)), F.lit(0), lambda n, e: n + (e < c).cast("int"))


def cdf(df: DataFrame, c: str, grid: list[float], by: list[str] = ()) -> DataFrame:
    """Fraction of values at or below each grid point."""
    a = df.groupBy(*by).agg(*(F.avg((F.col(c) <= g).cast("double")).alias(f"__{i}") for i, g in enumerate(grid)))
    return a.select(*by, F.inline(F.array(*(F.struct(F.lit(float(g)).alias("at"), F.col(f"__{i}").alias("cdf")) for i, g in enumerate(grid)))))


def pmf(df: DataFrame, c: str, edges: list[float], by: list[str] = ()) -> DataFrame:
    return df.where(F.col(c).isNotNull()).groupBy(*by, bin_index(F.col(c), edges).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def top_k(df: DataFrame, c: str, k: int = 50) -> DataFrame:
    """Category counts, most frequent first, ties by value; NULL is a category."""
    return df.groupBy(c).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_first(c)).limit(k)


def category_histogram(df: DataFrame, c: str, limit: int = 1024, keep: int = 256) -> DataFrame:
    """(category, n, regime): all categories while at most `limit`, else the largest
    `keep` and the rest as OTHER."""
    h = df.groupBy(F.col(c).cast("string").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    size = h.agg(F.count(F.lit(1)).alias("categories"))
    large = h.orderBy(F.desc("n"), "category").limit(keep).select(F.col("category").alias("__c"), F.lit(True).alias("large"))
    j = h.crossJoin(F.broadcast(size)).join(F.broadcast(large), F.col("category").eqNullSafe(F.col("__c")), "left")
    full = F.col("categories") <= limit
    name = F.when(full | F.col("large"), F.col("category")).otherwise("OTHER")
    return j.groupBy(name.alias("category"), F.when(full, "exact").otherwise("top").alias("regime")).agg(F.sum("n").alias("n"))


def frequency_encoding(df: DataFrame, c: str, limit: int = 512) -> DataFrame:
    """Adds <c>_share; NULL where the column has over `limit` categories.

    At most `limit` counts are broadcast, none if there are more: the table never moves."""
    h = df.groupBy(c).agg(F.count(F.lit(1)).alias("__n"))
    t = h.agg(F.sum("__n").alias("__all"), F.count(F.lit(1)).alias("__k"))
    shares = h.crossJoin(F.broadcast(t)).where(F.col("__k") <= limit).select(F.col(c).alias("__key"), (F.col("__n") / F.col("__all")).alias(f"{c}_share"))
    return df.join(F.broadcast(shares), df[c].eqNullSafe(F.col("__key")), "left").drop("__key")


def graph_shape(edges: DataFrame, s: str, t: str, by: list[str] = ()) -> DataFrame:
    """Edges, distinct ends and pairs, and the ratios of them; distinct counts in two
    grouped levels instead of an expanded distinct aggregate."""
    pairs = edges.groupBy(*by, s, t).agg(F.count(F.lit(1)).alias("__m"))
    src = pairs.groupBy(*by, s).agg(F.sum("__m").alias("__e"), F.count(F.lit(1)).alias("__p")).groupBy(*by).agg(F.sum("__e").alias("edges"), F.sum("__p").alias("distinct_edges"), F.count(F.lit(1)).alias("sources"))
    dst = pairs.groupBy(*by, t).agg(F.lit(1)).groupBy(*by).agg(F.count(F.lit(1)).alias("targets"))
    j = src.join(dst, list(by)) if by else src.crossJoin(dst)
    return j.select(
        *by, "edges", "sources", "targets", "distinct_edges",
        F.try_divide("edges", "sources").alias("mean_out_degree"), F.try_divide("edges", "targets").alias("mean_in_degree"),
        F.try_divide("edges", "distinct_edges").alias("edge_multiplicity"), F.try_divide("sources", "targets").alias("fan_in_out_ratio"),
    )


def degrees(edges: DataFrame, end: str, by: list[str] = ()) -> DataFrame:
    return edges.groupBy(*by, end).agg(F.count(F.lit(1)).alias("degree"))


def concentration(edges: DataFrame, end: str, top: int = 10, by: list[str] = ()) -> DataFrame:
    """Share of edges at the `top` entities of largest degree."""
    d = degrees(edges, end, by)
    if not by:
        head = d.orderBy(F.desc("degree"), end).limit(top).agg(F.sum("degree").alias("h"))
        return head.crossJoin(d.agg(F.sum("degree").alias("all"))).select((F.col("h") / F.col("all")).alias("share"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("degree"), end))
    head = d.withColumn("__r", rank).where(F.col("__r") <= top).groupBy(*by).agg(F.sum("degree").alias("__h"))  # a rank limit, cut before the shuffle
    return head.join(d.groupBy(*by).agg(F.sum("degree").alias("__t")), list(by)).select(*by, (F.col("__h") / F.col("__t")).alias("share"))


def pair_correlation(df: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    """r from variances of the parts and of the sum, clipped to 0.999999."""
    a = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.var_samp(F.col(x) + F.col(y)).alias("vs"), F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"))
    r = F.try_divide((F.col("vs") - F.col("vx") - F.col("vy")) / 2, F.sqrt(F.col("vx") * F.col("vy")))
    return a.select(*by, "n", F.greatest(F.least(r, F.lit(0.999999)), F.lit(-0.999999)).alias("r"))


# -- sketches -----------------------------------------------------------------------------


def theta_state(df: DataFrame, c: str, by: list[str] = (), lg_k: int = 12) -> DataFrame:
    return df.groupBy(*by).agg(F.theta_sketch_agg(c, lg_k).alias("state"))


def theta_merge(states: DataFrame, by: list[str] = (), lg_k: int = 12) -> DataFrame:
    return states.groupBy(*by).agg(F.theta_union_agg("state", lg_k).alias("state"))


def counted(states: DataFrame, df: DataFrame, c: str, by: list[str]) -> DataFrame:
    """Adds `counted`, the exact distinct values of `c` in df, to one state a group: what a
    sketch says is exact only below its 2^lg_k. A NULL group is a group."""
    keys = [F.col(k).alias(f"__k{i}") for i, k in enumerate(by)]
    n = df.groupBy(*by).agg(F.count_distinct(c).alias("counted")).select(*keys, "counted")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(by)))
    return states.join(n, same).select(*states.columns, "counted")


def theta_bounds(state, sigmas: float = 2.0, lg_k: int = 12) -> list[Column]:
    """Estimate and its bounds; exact below 2^lg_k."""
    e = F.theta_sketch_estimate(state)
    rel = F.when(e < (1 << lg_k), 0.0).otherwise(sigmas / (1 << lg_k) ** 0.5)
    return [e.alias("estimate"), (e * (1 - rel)).alias("low"), (e * (1 + rel)).alias("high")]


def hll_state(df: DataFrame, c: str, by: list[str] = (), lg_k: int = 12) -> DataFrame:
    return df.groupBy(*by).agg(F.hll_sketch_agg(c, lg_k).alias("state"))


def hll_merge(states: DataFrame, by: list[str] = ()) -> DataFrame:
    return states.groupBy(*by).agg(F.hll_union_agg("state").alias("state"))


def kll_state(df: DataFrame, c: str, by: list[str] = (), k: int = 200) -> DataFrame:
    return df.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(c).cast("double"), k).alias("state"))


def count_min_matrix(df: DataFrame, c: str, width: int = 2718, depth: int = 5) -> DataFrame:
    """Relational Count-Min: (row, cell, n); mergeable by `sum`, and never under-counts."""
    cells = F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda r: F.struct(r.alias("row"), F.pmod(F.xxhash64(r, F.col(c)), F.lit(width)).alias("cell")))
    h = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    return h.select(F.inline(cells), "n").groupBy("row", "cell").agg(F.sum("n").alias("n"))


def count_min_estimate(matrix: DataFrame, keys: DataFrame, c: str, width: int = 2718, depth: int = 5) -> DataFrame:
    cells = F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda r: F.struct(r.alias("row"), F.pmod(F.xxhash64(r, F.col(c)), F.lit(width)).alias("cell")))
    return keys.select(c, F.inline(cells)).join(matrix, ["row", "cell"], "left").groupBy(c).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def bloom_state(df: DataFrame, c: str, bits: int = 1 << 16, hashes: int = 5, by: list[str] = ()) -> DataFrame:
    """Set bits as rows (word, mask): merging is bit_or."""
    at = F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(F.xxhash64(i, F.col(c)), F.lit(bits)))
    b = df.select(*by, F.explode(at).alias("b"))
    return b.groupBy(*by, (F.shiftright("b", 6)).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("mask"))


def bloom_contains(keys: DataFrame, c: str, state: DataFrame, bits: int = 1 << 16, hashes: int = 5) -> DataFrame:
    at = F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(F.xxhash64(i, F.col(c)), F.lit(bits)))
    probes = keys.select(c, F.explode(at).alias("b")).withColumn("word", F.shiftright("b", 6))
    hit = F.expr("coalesce(mask, 0L) & shiftleft(1L, cast(b & 63 as int))") != 0
    return probes.join(state, "word", "left").groupBy(c).agg(F.bool_and(hit).alias("maybe"))


FEATURE_SLOTS = (
    [f"count_{x}" for x in ("rows", "nulls", "nonfinite", "distinct")] + ["null_rate", "distinct_ratio"]
    + [f"moment_{x}" for x in ("mean", "sd", "variance", "skewness", "kurtosis", "cv", "min", "max", "range", "sum")]
    + [f"cdf_{i}" for i in range(9)] + [f"quantile_{q}" for q in ("01", "05", "10", "25", "50", "75", "90", "95", "99")]
    + ["iqr", "tail_ratio"] + [f"top_{i}_share" for i in range(1, 11)] + ["hhi", "gini", "entropy"]
)


def feature_vector(df: DataFrame, c: str, grid: list[float], by: list[str] = (), min_cell: int = 20) -> DataFrame:
    """49 nullable numbers that describe a numeric column; groups below `min_cell` are blank."""
    x = finite(c)
    n, mean, sd = F.count(x), F.avg(x), F.stddev_samp(x)
    qs = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
    base = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count_rows"), (F.count(F.lit(1)) - F.count(c)).alias("count_nulls"), (F.count(c) - n).alias("count_nonfinite"), F.approx_count_distinct(c).alias("count_distinct"),
        mean.alias("moment_mean"), sd.alias("moment_sd"), F.var_samp(x).alias("moment_variance"), F.skewness(x).alias("moment_skewness"), F.kurtosis(x).alias("moment_kurtosis"),
        F.min(x).alias("moment_min"), F.max(x).alias("moment_max"), F.sum(x).alias("moment_sum"), *(F.avg((x <= g).cast("double")).alias(f"cdf_{i}") for i, g in enumerate(grid[:9])), F.percentile(x, qs).alias("__q"),
    )
    h = df.where(x.isNotNull()).groupBy(*by, x.alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    sizes = shares_shape(h, list(by), "__n").select(*by, "total", "hhi", "gini")
    logs = h.groupBy(*by).agg(F.sum(F.col("__n") * F.ln("__n")).alias("__l"))
    head = h.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("__n"), "__v"))).where(F.col("__r") <= 10)  # a rank limit
    tops = head.groupBy(*by).agg(*(F.max(F.when(F.col("__r") == i, F.col("__n"))).alias(f"__t{i}") for i in range(1, 11)))
    shape = sizes.join(logs, list(by)).join(tops, list(by)) if by else sizes.crossJoin(logs).crossJoin(tops)
    shape = shape.select(*by, "hhi", "gini", (F.ln("total") - F.col("__l") / F.col("total")).alias("entropy"), *((F.col(f"__t{i}") / F.col("total")).alias(f"top_{i}_share") for i in range(1, 11)))
    j = base.join(shape, list(by), "left") if by else base.crossJoin(shape)
    q = lambda i: F.element_at("__q", i + 1)
    j = j.withColumns({f"quantile_{str(x)[2:].ljust(2, '0')}": q(i) for i, x in enumerate(qs)})
    j = j.withColumns({
        "null_rate": F.try_divide("count_nulls", "count_rows"), "distinct_ratio": F.try_divide("count_distinct", "count_rows"), "moment_cv": F.try_divide("moment_sd", F.abs("moment_mean")),
        "moment_range": F.col("moment_max") - F.col("moment_min"), "iqr": F.col("quantile_75") - F.col("quantile_25"), "tail_ratio": F.try_divide("quantile_99", "quantile_50"),
    })
    blank = F.col("count_rows") < min_cell
    return j.select(*by, *(F.when(~blank, F.col(c).cast("double")).alias(c) for c in FEATURE_SLOTS))

