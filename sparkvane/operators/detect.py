"""Detectors: metadata series, drift, heavy hitters, segments, graphs, correlation, scores.

Every detector returns one row per comparison with a status; a comparison that
cannot be made is a row that says why, never a missing row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.scalars import leading_digit
from . import compare as C
from . import series as S
from .aggregates import concentration, graph_shape

ALPHA, MIN_SUPPORT, TOP, MIN_HISTORY = 0.05, 100, 10, 5


# -- metadata ---------------------------------------------------------------------------------


def row_volume(counts: DataFrame, at: str, n: str = "n") -> DataFrame:
    """Log-ratio series of row counts."""
    return S.evaluate_deltas(S.log_ratio(counts, n, at), "log_ratio", at, 0.5)


def bounds_drift(bounds: DataFrame, at: str, lo: str, hi: str, by: list[str] = ()) -> DataFrame:
    """Range growth and midpoint moves of a numeric column, both as delta series."""
    w = S.over(by, at)
    b = bounds.withColumns({"range": F.col(hi) - F.col(lo), "mid": (F.col(hi) + F.col(lo)) / 2})
    before, mid = F.lag("range").over(w), F.lag("mid").over(w)
    b = b.withColumn("range_delta", F.when((F.col("range") > 0) & (before > 0), F.ln(F.col("range") / before)))
    b = b.withColumn("mid_delta", F.when(before > 0, (F.col("mid") - mid) / before))
    r = S.evaluate_deltas(b, "range_delta", at, 0.5, by).select(*by, at, F.lit("range").alias("measure"), F.col("range_delta").alias("delta"), "z", "fired")
    m = S.evaluate_deltas(b, "mid_delta", at, 0.5, by).select(*by, at, F.lit("mid").alias("measure"), F.col("mid_delta").alias("delta"), "z", "fired")
    return r.unionByName(m)


def proportion_shift(counts: DataFrame, at: str, k: str, n: str, by: list[str] = (), least_h: float = 0.1) -> DataFrame:
    """Rate of each period against the one before: pooled z and Cohen's h."""
    w = S.over(by, at)
    k0, n0 = F.lag(k).over(w), F.lag(n).over(w)
    c = counts.withColumns({"k0": k0, "n0": n0}).where("n0 is not null")
    c = c.withColumn("z", K.two_proportion_z(F.col(k), F.col(n), F.col("k0"), F.col("n0"))).withColumn("h", K.cohens_h(F.col(k) / F.col(n), F.col("k0") / F.col("n0")))
    return c.withColumn("fired", F.coalesce((F.abs("z") >= 2.5758293035489004) & (F.abs("h") >= least_h), F.lit(False)))


def schema_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Added, removed and retyped columns of two (column, type) tables."""
    a, b = before.select("column", F.col("type").alias("old")), after.select("column", F.col("type").alias("new"))
    j = a.join(b, "column", "full")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("retyped")
    return j.where("not (old <=> new)").select("column", kind.alias("change"), "old", "new")


def naive_rule(counts: DataFrame, at: str, n: str = "n", nulls: str | None = None) -> DataFrame:
    """Row count moved by more than e^0.5, or over half of the values null."""
    out = S.log_ratio(counts, n, at).withColumn("volume_flag", F.coalesce(F.abs("log_ratio") > 0.5, F.lit(False)))
    return out.withColumn("null_flag", F.col(nulls) / F.col(n) > 0.5) if nulls else out


# -- drift --------------------------------------------------------------------------------------


def trailing_histograms(h: DataFrame, at: str, key: str, n: int) -> DataFrame:
    """(at, key, n1, n0): each period against the sum of the n periods before it, on a
    dense spine so that an absent category counts 0.

    The periods, one row each, are what is broadcast; keys may be many and stay where they
    are. trailing_pairs has no spine."""
    periods = h.agg(F.collect_set(at).alias(at))
    spine = h.select(key).distinct().crossJoin(F.broadcast(periods)).withColumn(at, F.explode(at))
    d = spine.join(h, [at, key], "left").na.fill(0, ["n"])
    base = F.sum("n").over(Window.partitionBy(key).orderBy(at).rowsBetween(-n, -1))
    return d.select(at, key, F.col("n").alias("n1"), base.alias("n0"))


def drift_status(n1: Column, n0: Column, least: int = MIN_SUPPORT) -> Column:
    return F.when(n0.isNull() | (n0 == 0), "NO_BASELINE").when(n1 < least, "THIN_SKETCH").when(n0 < least, "THIN_BASELINE").otherwise("OK")


def category_drift(h: DataFrame, at: str, key: str, trailing: int = 7, least: int = MIN_SUPPORT) -> DataFrame:
    """PSI, JS and G of the category mix by period; sparse categories are pooled first."""
    pairs = trailing_histograms(h, at, key, trailing).na.fill(0, ["n0"])
    c = C.compare(pairs, [at])
    return c.withColumn("status", drift_status(F.col("n1"), F.col("n0"), least))


def with_p(df: DataFrame, phi: float = 1.0) -> DataFrame:
    """p of PSI (scaled to chi-square) and of G, for rows that could be compared."""
    ok = F.col("status") == "OK"
    d = df.withColumn("psi_p", K.chi2_p(F.when(ok, F.col("psi_chi") / phi), F.col("df").cast("double")))
    return d.withColumn("g_p", K.chi2_p(F.when(ok, F.col("g") / phi), F.col("df").cast("double")))


def numeric_drift(df: DataFrame, x: str, at: str, edges: list[float], trailing: int = 7) -> DataFrame:
    """W1, KS and PSI of a numeric column by period over fixed edges, against the periods before."""
    from .aggregates import bin_index

    h = df.groupBy(at, bin_index(F.col(x), edges).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = df.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("bin"))
    spine = h.select(at).distinct().crossJoin(F.broadcast(bins))
    d = spine.join(h, [at, "bin"], "left").na.fill(0, ["n"])
    base = F.sum("n").over(Window.partitionBy("bin").orderBy(at).rowsBetween(-trailing, -1))
    upper = F.get(F.array(*map(F.lit, edges)), F.col("bin"))
    d = d.select(at, "bin", upper.alias("edge"), F.col("n").alias("n1"), base.alias("n0")).where("n0 is not null")
    w = C.wasserstein(d, "edge", [at])
    return w.join(C.compare(d.select(at, "bin", "n1", "n0"), [at]).select(at, "psi"), at).withColumn("direction", F.when(F.col("signed_w1") > 0, "UP").otherwise("DOWN")).withColumn("status", drift_status(F.col("n1"), F.col("n0")))


# -- heavy hitters -------------------------------------------------------------------------------


def trailing_pairs(h: DataFrame, at: str, key: str, n: int) -> DataFrame:
    """As trailing_histograms, but only with keys seen now or in the baseline: each count is
    handed to the n periods after it, so there is no spine of all periods and keys."""
    steps = h.select(at).distinct().withColumn("__i", F.row_number().over(Window.orderBy(at)))  # one row a period
    d = h.join(F.broadcast(steps), at).select("__i", key, "n")
    ref = d.select(F.explode(F.sequence(F.col("__i") + 1, F.col("__i") + n)).alias("__i"), key, "n").groupBy("__i", key).agg(F.sum("n").alias("n0"))
    j = d.withColumnRenamed("n", "n1").join(ref, ["__i", key], "full").na.fill(0, ["n1", "n0"])
    return j.join(F.broadcast(steps), "__i").where("__i > 1").select(at, key, "n1", "n0")


def heavy_hitter_shift(h: DataFrame, at: str, key: str, trailing: int = 7, k: int = TOP) -> DataFrame:
    """z of every key that is among the k largest now or in the baseline; entrants and exits named.

    Top sets are plain rank limits, which Spark cuts before the shuffle."""
    p = trailing_pairs(h, at, key, trailing)

    def top(c: str, name: str) -> DataFrame:
        r = F.row_number().over(Window.partitionBy(at).orderBy(F.desc(c), key))
        return p.where(F.col(c) > 0).withColumn("__r", r).where(F.col("__r") <= k).select(at, key, F.lit(True).alias(name))

    totals = p.groupBy(at).agg(F.sum("n1").alias("t1"), F.sum("n0").alias("t0"))
    keys = top("n1", "__now").join(top("n0", "__ref"), [at, key], "full")
    t = p.join(keys, [at, key]).join(totals, at)
    t = t.withColumn("z", K.two_proportion_z(F.col("n1"), F.col("t1"), F.col("n0"), F.col("t0")))
    now, ref = F.coalesce("__now", F.lit(False)), F.coalesce("__ref", F.lit(False))
    label = F.when(~ref & (F.col("z") > 0), "APPEARED").when(~now & (F.col("z") < 0), "VANISHED").when(F.col("z") > 0, "UP").otherwise("DOWN")
    return t.select(at, key, "n1", "n0", "t1", "t0", "z", label.alias("label"))


def rank_churn(h: DataFrame, at: str, key: str, k: int = TOP) -> DataFrame:
    """1 - overlap of the top sets of consecutive periods."""
    r = h.withColumn("r", F.row_number().over(Window.partitionBy(at).orderBy(F.desc("n"), key))).where(F.col("r") <= k)
    tops = r.groupBy(at).agg(F.array_sort(F.collect_list(F.col(key).cast("string"))).alias("top"))
    before = F.lag("top").over(Window.orderBy(at))
    t = tops.withColumn("before", before).where("before is not null")
    size = F.least(F.size("top"), F.size("before"))
    return t.select(at, (1 - F.size(F.array_intersect("top", "before")) / size).alias("churn"), F.size(F.array_except("top", "before")).alias("entrants"), F.size(F.array_except("before", "top")).alias("exits"))


# -- segments ------------------------------------------------------------------------------------


def leave_one_out(panel: DataFrame, segment: str) -> DataFrame:
    """Moments of each segment against the pool of all others (panel: segment, n, s1, s2)."""
    every = panel.agg(*(F.sum(c).alias(f"__{c}") for c in ("n", "s1", "s2")))
    p = panel.crossJoin(F.broadcast(every)).withColumns({f"o{c}": F.col(f"__{c}") - F.col(c) for c in ("n", "s1", "s2")})
    v = lambda n, a, b: (F.col(b) - F.col(a) * F.col(a) / F.col(n)) / (F.col(n) - 1)
    return p.select(segment, "n", F.col("on").alias("peers_n"), (F.col("s1") / F.col("n")).alias("mean"), (F.col("os1") / F.col("on")).alias("peers_mean"), v("n", "s1", "s2").alias("variance"), v("on", "os1", "os2").alias("peers_variance"))


def segment_divergence_mean(df: DataFrame, x: str, segment: str, least: int = 30) -> DataFrame:
    panel = df.groupBy(segment).agg(F.count(x).alias("n"), F.sum(x).alias("s1"), F.sum(F.col(x) * F.col(x)).alias("s2")).where(F.col("n") >= least)
    d = leave_one_out(panel, segment)
    a = [F.col(c) for c in ("mean", "variance", "n", "peers_mean", "peers_variance", "peers_n")]
    return d.withColumn("z", K.welch_z(*a)).withColumn("d", K.cohens_d(a[0], a[1], a[3], a[4]))


def segment_divergence_null(df: DataFrame, c: str, segment: str, least: int = 30) -> DataFrame:
    panel = df.groupBy(segment).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count(c)).alias("nulls")).where(F.col("n") >= least)
    every = panel.agg(F.sum("n").alias("__n"), F.sum("nulls").alias("__nulls"))
    p = panel.crossJoin(F.broadcast(every)).withColumns({"peers_n": F.col("__n") - F.col("n"), "peers_nulls": F.col("__nulls") - F.col("nulls")}).drop("__n", "__nulls")
    return p.withColumn("z", K.two_proportion_z(F.col("nulls"), F.col("n"), F.col("peers_nulls"), F.col("peers_n")))


def segment_divergence_mix(df: DataFrame, key: str, segment: str, least: int = 30, most: int = 2000) -> DataFrame:
    """G of each segment's category mix against the pooled mix of the others.

    Segments are a panel and refused beyond `most`; they are what is broadcast, so keys
    may be many."""
    h = df.groupBy(segment, key).agg(F.count(F.lit(1)).alias("n"))
    if h.select(segment).distinct().limit(most + 1).count() > most:
        raise ValueError(f"over {most} segments")
    segs = h.groupBy(segment).agg(F.lit(1).alias("__one")).drop("__one")
    d = h.select(key).distinct().crossJoin(F.broadcast(segs))
    there = h.select(F.col(segment).alias("__s"), F.col(key).alias("__k"), "n")
    d = d.join(there, F.col(segment).eqNullSafe(F.col("__s")) & F.col(key).eqNullSafe(F.col("__k")), "left").drop("__s", "__k").na.fill(0, ["n"])
    d = d.withColumn("n0", F.sum("n").over(Window.partitionBy(key)) - F.col("n")).select(segment, key, F.col("n").alias("n1"), "n0")
    return C.compare(d, [segment]).where(F.col("n1") >= least)


def trim_segments(panel: list[dict], test, min_peers: int = 4, alpha: float = ALPHA) -> list[str]:
    """Sequential trimming over a panel of K rows on the driver: the segment of least p
    is set aside and the rest tested anew, while enough peers stay."""
    out: list[str] = []
    while True:
        rest = [r for r in panel if r["segment"] not in out]
        if len(rest) < 2:
            return out
        p, name = min((test(r, [o for o in rest if o is not r]), r["segment"]) for r in rest)
        if p > alpha or len(rest) <= min_peers:
            return out
        out.append(name)


def emerging(now: DataFrame, then: DataFrame, segment: str) -> DataFrame:
    """Difference in differences of segment means between two panels (as of segment_divergence_mean)."""
    se = lambda a: F.sqrt(F.col(f"{a}.variance") / F.col(f"{a}.n") + F.col(f"{a}.peers_variance") / F.col(f"{a}.peers_n"))
    diff = lambda a: F.col(f"{a}.mean") - F.col(f"{a}.peers_mean")
    j = now.alias("a").join(then.alias("b"), segment, "left")
    z = (diff("a") - diff("b")) / F.sqrt(se("a") ** 2 + se("b") ** 2)
    return j.select(segment, diff("a").alias("diff_now"), diff("b").alias("diff_then"), z.alias("z"), F.when(F.col("b.n").isNull(), "NEW_SEGMENT").otherwise("OK").alias("status"))


# -- graphs, correlation ---------------------------------------------------------------------------

GRAPH_METRICS = {"mean_in_degree": "log", "mean_out_degree": "log", "fan_in_out_ratio": "log", "edge_multiplicity": "log", "concentration_in": "logit", "concentration_out": "logit"}


def graph_series(edges: DataFrame, s: str, t: str, at: str) -> DataFrame:
    g = graph_shape(edges, s, t, [at])
    ci = concentration(edges, t, TOP, [at]).withColumnRenamed("share", "concentration_in")
    co = concentration(edges, s, TOP, [at]).withColumnRenamed("share", "concentration_out")
    return g.join(ci, at).join(co, at)


def graph_anomaly(edges: DataFrame, s: str, t: str, at: str, trailing: int = 12) -> DataFrame:
    """Prediction t of each shape metric against the windows before (at least MIN_HISTORY)."""
    g = graph_series(edges, s, t, at)
    p = lambda c: F.greatest(F.least(F.col(c), F.lit(1 - 1e-6)), F.lit(1e-6))
    value = {m: F.ln(F.col(m)) if how == "log" else F.ln(p(m) / (1 - p(m))) for m, how in GRAPH_METRICS.items()}
    long = g.select(at, "edges", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in value.items()))))
    w = Window.partitionBy("metric").orderBy(at).rowsBetween(-trailing, -1)
    long = long.withColumns({"k": F.count("value").over(w), "mean": F.avg("value").over(w), "sd": F.stddev_samp("value").over(w)})
    t_ = K.prediction_t(F.col("value"), F.col("mean"), F.col("sd"), F.col("k"))
    status = F.when(F.col("k") < MIN_HISTORY, "NO_BASELINE").when(F.col("edges") < MIN_SUPPORT, "THIN_SKETCH").otherwise("OK")
    return long.select(at, "metric", "value", "k", F.when(status == "OK", t_).alias("t"), status.alias("status"))


def correlation_shift(df: DataFrame, x: str, y: str, at: str, tau: float = 0.3, least: int = 50) -> DataFrame:
    """Correlation of consecutive periods: edges that appear, vanish or flip."""
    c = df.groupBy(at).agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("r"))
    w = Window.orderBy(at)
    c = c.withColumns({"n0": F.lag("n").over(w), "r0": F.lag("r").over(w)}).where("n0 is not null")
    a, b = F.abs("r"), F.abs("r0")
    label = F.when((b < tau) & (a >= tau), "APPEARED").when((b >= tau) & (a < tau), "VANISHED").when((a >= tau) & (b >= tau) & (F.signum("r") != F.signum("r0")), "CHANGED").otherwise("NONE")
    ok = (F.col("n") >= least) & (F.col("n0") >= least)
    z = K.fisher_z(F.col("r"), F.col("n"), F.col("r0"), F.col("n0"))
    return c.select(at, "n", "n0", "r", "r0", F.when(ok, z).alias("z"), F.when(ok, label).otherwise("THIN").alias("label"))


# -- tail scores -------------------------------------------------------------------------------------


def tail_scores(df: DataFrame, ident: str, cols: list[str], method: str = "ecod") -> DataFrame:
    """ECOD or COPOD score per row with its conformal p.

    Tails are taken per distinct value and joined back; the row keeps one record per column."""
    m = df.agg(*(F.skewness(c).alias(c) for c in cols), *(F.count_distinct(c).alias(f"d_{c}") for c in cols))
    long = df.select(ident, F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in cols)))).where(F.col("x").isNotNull())
    tails = S.ecdf_tails(long, "x", ["column"])
    skew = m.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("skew"), F.col(f"d_{c}").alias("k")) for c in cols))))
    j = long.join(tails, ["column", "x"]).join(F.broadcast(skew), "column").where("k > 1")
    by = F.when(F.col("skew") < 0, F.col("left_tail")).otherwise(F.col("right_tail"))
    if method == "ecod":
        s = j.groupBy(ident).agg(F.greatest(F.sum("left_tail"), F.sum("right_tail"), F.sum(by)).alias("score"))
    else:
        s = j.groupBy(ident).agg(F.sum(F.greatest(by, (F.col("left_tail") + F.col("right_tail")) / 2)).alias("score"))
    s = s.withColumn("score", F.round("score", 9))  # equal rows stay tied whatever the order of sums
    h = s.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    c = S.cumulative(h, "score", "n")
    return s.join(c.select("score", ((F.col("total") - F.col("cum") + F.col("n")) / F.col("total")).alias("p")), "score")


def matrix_profile(values: list[float], m: int = 8) -> list[tuple[float, int]]:
    """(distance, neighbour) of each z-normalised subsequence of length m."""
    import numpy as np

    x = np.lib.stride_tricks.sliding_window_view(np.asarray(values, float), m)
    sd = x.std(1)
    z = np.where(sd[:, None] > 1e-12, (x - x.mean(1)[:, None]) / np.where(sd > 1e-12, sd, 1)[:, None], 0.0)
    d = np.sqrt(np.maximum(0, (z * z).sum(1)[:, None] + (z * z).sum(1)[None, :] - 2 * z @ z.T))
    i = np.arange(len(x))
    d[np.abs(i[:, None] - i[None, :]) < math.ceil(m / 4)] = np.inf
    return [(float(a), int(b)) for a, b in zip(d.min(1), d.argmin(1))]


def matrix_profile_findings(df: DataFrame, series: str, at: str, x: str, m: int = 8, discord: float = 1.5, motif: float = 0.35) -> DataFrame:
    """Discords and motifs among the last m starts of each series (at least 4 m points).

    One series of periods per group: small by construction."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.dropna(subset=[x]).sort_values(at)
        cols = [series, "start", "distance", "kind"]
        if len(pdf) < 4 * m:
            return pd.DataFrame([[pdf[series].iloc[0], None, None, "THIN"]], columns=cols) if len(pdf) else pd.DataFrame(columns=cols)
        prof = matrix_profile(pdf[x].tolist(), m)
        scale = max(float(np.median([d for d, _ in prof])), 0.01 * math.sqrt(2 * m))
        rows = []
        for i in range(len(prof) - m, len(prof)):
            d = prof[i][0]
            kind = "DISCORD" if d >= discord * scale else "MOTIF" if d <= motif * scale else "NONE"
            rows.append([pdf[series].iloc[0], str(pdf[at].iloc[i]), round(d, 6), kind])
        return pd.DataFrame(rows, columns=cols)

    kind = df.schema[series].dataType.simpleString()
    return df.select(series, at, x).groupBy(series).applyInPandas(run, f"{series} {kind}, start string, distance double, kind string")


def benford(df: DataFrame, x: str, by: list[str] = ()) -> DataFrame:
    """Chi-square of leading digits against log10(1 + 1/d), eight degrees of freedom."""
    h = df.withColumn("digit", leading_digit(x)).where("digit is not null").groupBy(*by, "digit").agg(F.count(F.lit(1)).alias("n"))
    t = h.groupBy(*by).agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col("digit") == d, F.col("n")).otherwise(0)).alias(f"d{d}") for d in range(1, 10)))
    chi = sum((F.pow(F.col(f"d{d}") - F.col("n") * math.log10(1 + 1 / d), 2) / (F.col("n") * math.log10(1 + 1 / d)) for d in range(1, 10)), F.lit(0.0))
    return t.select(*by, "n", chi.alias("chi2"))


def to_candidates(findings: DataFrame, p: str, detector: str, subject: str) -> DataFrame:
    """Uniform candidates, scored by -log10 p."""
    return findings.select(F.lit(detector).alias("detector"), F.col(subject).cast("string").alias("subject"), F.col(p).alias("p_value"), F.when(F.col(p) > 0, -F.log10(p)).alias("score"))
