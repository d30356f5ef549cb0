import random

from pyspark.sql import functions as F

from sparkvane.operators import detect as D
from sparkvane.operators import panels as P


def test_the_moved_segment_is_found_and_alone(spark):
    rng = random.Random(2)
    rows = [(s, rng.gauss(1.0 if s == "x" else 0.0, 1)) for s in "abcdefgx" for _ in range(300)]
    got = P.segment_findings(spark.createDataFrame(rows, "s string, v double"), "v", "s").collect()
    assert [r.segment for r in got if r.p <= 0.05 / 8] == ["x"] and len(got) == 8
    thin = P.segment_findings(spark.createDataFrame(rows[:600], "s string, v double"), "v", "s").collect()
    assert {r.status for r in thin} == {"THIN_PANEL"} and len(thin) == 2


def test_funnel_and_collectors(spark):
    rng = random.Random(3)
    rows = [(w, rng.randrange(200), rng.randrange(300)) for w in range(12) for _ in range(600)]
    rows += [(12, rng.randrange(200), rng.randrange(1000, 1003) if rng.random() < 0.5 else rng.randrange(300)) for _ in range(600)]
    e = spark.createDataFrame(rows, "w int, s int, t int")
    f = {r.w: r.p for r in P.funnel(D.graph_anomaly(e, "s", "t", "w"), "w").collect()}
    assert f[12] < 1e-3 and min(p for w, p in f.items() if w < 12) > 1e-3
    c = P.new_collectors(e, "t", "w").where("w = 12").select("t").collect()
    assert {1000, 1001, 1002} <= {r.t for r in c}


def test_series_status(spark):
    d = spark.createDataFrame([(1, 200), (2, 300), (3, None), (4, 10), (6, 500)], "i int, n int")
    assert [r.status for r in P.series_status(d, "i", "n").orderBy("i").collect()] == ["NO_BASELINE", "OK", "GAP", "THIN_SKETCH", "IRREGULAR"]
    assert P.series_status(d.where(F.lit(False)), "i", "n").count() == 0


def test_cumulative_and_ranks_over_many_ranges(spark):
    from itertools import groupby

    from sparkvane.operators import series as S

    rng = random.Random(8)
    rows = [(i, i % 3, rng.choice([rng.gauss(0, 1), 0.5, -2.0]), rng.randint(0, 1)) for i in range(4000)]
    d = spark.createDataFrame(rows, "i int, g int, x double, y int")
    h = d.groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"))
    got = {(r.g, r.x): (r.cum, r.total) for r in S.cumulative(h, "x", "n", ["g"]).collect()}
    for g in range(3):
        xs, cum = sorted(x for _, k, x, _ in rows if k == g), 0
        for x, same in groupby(xs):
            cum += len(list(same))
            assert got[(g, x)] == (cum, len(xs))
    want, hits = {}, 0
    for k, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])), 1):
        hits += r[3]
        want[r[0]] = (k, hits)
    assert {r.i: (r.rank, r.cum) for r in S.ranked(d, "x", "i", "y").collect()} == want
    assert S.cumulative(h.limit(0), "x", "n", ["g"]).count() == 0 and S.ranked(d.limit(0), "x", "i").count() == 0


def test_feature_vector_shape(spark):
    import math

    from sparkvane.operators import aggregates as A

    d = spark.createDataFrame([("a", float(v)) for v in [1] * 30 + [2] * 15 + [3] * 5] + [("b", 1.0)] * 3, "g string, x double")
    r = {x.g: x for x in A.feature_vector(d, "x", [1, 2, 3, 4, 5, 6, 7, 8, 9], ["g"]).collect()}
    n = [30, 15, 5]
    assert len(A.FEATURE_SLOTS) == len(set(A.FEATURE_SLOTS)) == 49 and r["b"].moment_mean is None
    assert abs(r["a"].hhi - sum((x / 50) ** 2 for x in n)) < 1e-9 and abs(r["a"].entropy + sum(x / 50 * math.log(x / 50) for x in n)) < 1e-9
    assert abs(r["a"].gini - (2 * (1 * 5 + 2 * 15 + 3 * 30) / (3 * 50) - 4 / 3)) < 1e-9
    assert (r["a"].top_1_share, r["a"].top_3_share, r["a"].top_4_share, r["a"].cdf_0) == (0.6, 0.1, None, 0.6)


def test_null_slices_and_scores_stay(spark):
    from sparkvane.operators import series as S

    d = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (3, None, 2.0), (4, None, 2.0), (5, None, None), (6, "a", None)], "i int, g string, x double")
    assert {r.i: r.avg_rank for r in S.average_rank(d, "x", ["g"]).collect()} == {1: 1.0, 2: 2.0, 3: 1.5, 4: 1.5, 5: None, 6: None}
    h = d.where("x is not null").groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"))
    assert {(r.g, r.x): (r.cum, r.total) for r in S.cumulative(h, "x", "n", ["g"]).collect()} == {("a", 1.0): (1, 2), ("a", 3.0): (2, 2), (None, 2.0): (2, 2)}
    assert {(r.g, r.x) for r in S.ecdf_tails(d, "x", ["g"]).collect()} == {("a", 1.0), ("a", 3.0), (None, 2.0)}


def test_own_history_in_buckets_is_that_of_one_window(spark):
    import datetime as dt

    from sparkvane.operators import features as FE

    rng = random.Random(4)
    at = lambda s: dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(seconds=s)
    rows = [(i, rng.choice(["hot", "hot", "b", None]), at(rng.randrange(-3000, 3000)) if i % 20 else None, rng.randint(1, 9)) for i in range(300)]
    d = spark.createDataFrame(rows, "i int, e string, ts timestamp, v int")
    for rule in (FE.Rule(500 * FE.SECOND), FE.Rule(700 * FE.SECOND, 100 * FE.SECOND, True)):
        got = {r.i: r.value for r in FE.pit_self(d, "e", "ts", F.sum("v"), rule).collect()}
        assert len(got) == 300
        for i, e, t, _ in rows:
            if t is not None:
                lag = lambda x: (t - x).total_seconds() * FE.SECOND
                near = [v for _, o, x, v in rows if o == e and x is not None and lag(x) <= rule.lookback and (lag(x) >= rule.embargo if rule.inclusive_end else lag(x) > rule.embargo)]
                assert got[i] == (sum(near) if near else None)
