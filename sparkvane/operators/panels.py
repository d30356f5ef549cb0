"""Panel findings: divergent segments with trimming, graph funnels, new collectors, series checks."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..sources.tables import fetch_aggregate

SIGNED = {"mean_in_degree": 1, "fan_in_out_ratio": 1, "edge_multiplicity": -1, "concentration_in": 1}


def _welch(a: dict, b: dict) -> tuple[float, float]:
    """(z, difference over the pooled sd) of two pools of (n, s1, s2)."""
    m = [x["s1"] / x["n"] for x in (a, b)]
    v = [max(0.0, (x["s2"] - x["s1"] ** 2 / x["n"]) / (x["n"] - 1)) for x in (a, b)]
    se, sd = (v[0] / a["n"] + v[1] / b["n"]) ** 0.5, ((v[0] + v[1]) / 2) ** 0.5
    return ((m[0] - m[1]) / se if se else 0.0, (m[0] - m[1]) / sd if sd else 0.0)


def _pool(rows: list[dict]) -> dict:
    return {k: sum(r[k] for r in rows) for k in ("n", "s1", "s2")}


def segment_findings(df: DataFrame, x: str, segment: str, alpha: float = 0.05, min_peers: int = 4, least: int = 30, most: int = 2000) -> DataFrame:
    """Segments whose mean departs from the pool of the others.

    Overdispersion comes from all pairs; the segment of least p leaves every other's
    reference, and the rest are tested anew, while over `min_peers` stay. The panel is
    one row a segment and is refused beyond `most` of them. Columns: segment, n, z, d,
    p, status (OK, THIN_PANEL); a panel of fewer than four segments gives THIN_PANEL rows."""
    spark = df.sparkSession
    v = F.col(x).cast("double")
    rows = [r.asDict() for r in fetch_aggregate(df.groupBy(F.col(segment).cast("string").alias("segment")).agg(F.count(v).alias("n"), F.sum(v).alias("s1"), F.sum(v * v).alias("s2")).where(F.col("n") >= least), most)]
    schema = "segment string, n long, z double, d double, p double, status string"
    if len(rows) < 4:
        return spark.createDataFrame([(r["segment"], r["n"], None, None, None, "THIN_PANEL") for r in rows], schema)
    phi = K.dispersion([(_welch(a, b)[0] ** 2, 1) for a, b in combinations(rows, 2)])
    out, found = [], {}
    while True:
        tested = []
        for r in rows:
            if r["segment"] in found:
                continue
            peers = _pool([o for o in rows if o is not r and o["segment"] not in found])
            z, d = _welch(r, peers)
            tested.append((K.chi2_sf(z * z / phi, 1), r["segment"], r["n"], z, d))
        p, name, n, z, d = min(tested)
        if p > alpha or len(tested) <= min_peers:
            break
        found[name] = (name, n, z, d, p, "OK")
    out = [*found.values(), *((s, n, z, d, p, "OK") for p, s, n, z, d in tested if s not in found)]
    return spark.createDataFrame(out, schema)


def funnel(anomaly: DataFrame, at: str) -> DataFrame:
    """Fisher's combination of the one-sided tails of the signed shape metrics of a window
    (as of detect.graph_anomaly); at least three of them."""
    sign = F.element_at(F.create_map(*(x for k, v in SIGNED.items() for x in (F.lit(k), F.lit(v)))), F.col("metric"))
    d = anomaly.where(F.col("metric").isin(*SIGNED) & (F.col("status") == "OK") & F.col("t").isNotNull())
    d = d.withColumn("tail", K.student_tail(F.col("t") * sign, (F.col("k") - 1).cast("double")))
    g = d.groupBy(at).agg((-2 * F.sum(F.ln(F.greatest("tail", F.lit(1e-300))))).alias("stat"), F.count(F.lit(1)).alias("metrics"))
    return g.where("metrics >= 3").withColumn("p", K.chi2_p(F.col("stat"), (2 * F.col("metrics")).cast("double")))


def new_collectors(edges: DataFrame, target: str, at: str, trailing: int = 12, k: int = 10) -> DataFrame:
    """Targets among the k largest of a window that were not among the k largest of the
    windows before it, pooled."""
    d = edges.groupBy(at, target).agg(F.count(F.lit(1)).alias("n"))
    steps = d.select(at).distinct().withColumn("i", F.row_number().over(Window.orderBy(at)))  # one row a window
    d = d.join(F.broadcast(steps), at)
    later = F.explode(F.sequence(F.col("i") + 1, F.col("i") + trailing)).alias("i")
    ref = d.select(target, "n", later).groupBy("i", target).agg(F.sum("n").alias("n"))
    top = lambda x, keys: x.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), target))).where(F.col("r") <= k)
    now = top(d, ["i"]).where("i > 1").select(at, "i", target, "n")
    return now.join(top(ref, ["i"]).select("i", target), ["i", target], "left_anti").drop("i")


def series_status(points: DataFrame, at: str, n: str, by: list[str] = (), least: int = 100) -> DataFrame:
    """Status of every point of an integer-indexed series: GAP (no value), NO_BASELINE (the
    first), IRREGULAR (a step unlike the first step), THIN_SKETCH, OK; never a missing row."""
    w = Window.partitionBy(*by).orderBy(at)
    step = F.col(at) - F.lag(at).over(w)
    p = points.withColumn("__step", step)
    first = F.first("__step", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = F.when(F.col(n).isNull(), "GAP").when(F.col("__step").isNull(), "NO_BASELINE").when(F.col("__step") != first, "IRREGULAR").when(F.col(n) < least, "THIN_SKETCH").otherwise("OK")
    return p.withColumn("status", s).drop("__step")
