import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sparkvane.operators import aggregates as A
from sparkvane.operators import compare as C
from sparkvane.operators import context as CX
from sparkvane.operators import detect as D
from sparkvane.operators import disclosure as DC
from sparkvane.operators import evaluate as EV
from sparkvane.operators import features as FE
from sparkvane.operators import findings as FS
from sparkvane.operators import series as S
from sparkvane.plans import plugins as P
from sparkvane.sources import tables as R
from sparkvane.streaming import stream as SS


def test_moment_states_merge_to_the_whole(spark):
    rng = random.Random(1)
    xs = [rng.lognormvariate(0, 0.5) for _ in range(500)]
    d = spark.createDataFrame([(i % 7, x) for i, x in enumerate(xs)], "g int, x double")
    m = A.finish_moment_state(A.merge_moment_states(A.moment_state(d, "x", ["g"], 1.0)), 1.0).first()
    n, mean = len(xs), sum(xs) / len(xs)
    assert m.n == n and m.mean == pytest.approx(mean) and m.variance == pytest.approx(sum((x - mean) ** 2 for x in xs) / (n - 1))
    m2, m3, m4 = (sum((x - mean) ** p for x in xs) for p in (2, 3, 4))
    assert m.skewness == pytest.approx(math.sqrt(n) * m3 / m2**1.5) and m.kurtosis == pytest.approx(n * m4 / m2**2 - 3)


def test_nonfinite_values_are_counted_apart(spark):
    d = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,), (3.0,)], "x double")
    m = A.moments(d, "x").first()
    assert (m.n, m.mean, m.nonfinite, m.max) == (2, 2.0, 2, 3.0)


def test_robust_z(spark):
    d = spark.createDataFrame([(i, float(x)) for i, x in enumerate([10, 11, 9, 10, 30, 5, 5, 5])], "t int, x double")
    z = {r.t: r.z for r in S.robust_z(d, "x", "t").collect()}
    assert z[2] is None and z[4] == pytest.approx((30 - 10) / (1.4826 * 0.5))


def test_ordered_collapse():
    assert C.collapse_ordered([(1, 1), (1, 1), (50, 50), (1, 0)]) == [(53, 52)]
    assert C.collapse_ordered([(20, 20), (20, 20), (1, 1)]) == [(20, 20), (21, 21)]


def test_gaps_stay_gaps(spark):
    d = spark.createDataFrame([("2024-01-01", 1), ("2024-01-04", 2)], "day string, n int").withColumn("day", F.to_date("day"))
    assert [r.n for r in S.gap_spine(d, "day").orderBy("day").collect()] == [1, None, None, 2]


def test_pit_never_sees_the_present_or_future(spark):
    rows = [(i, i % 3, 1_700_000_000 + 600 * i, float(i)) for i in range(60)]
    e = spark.createDataFrame(rows, "id int, u int, s long, v double").withColumn("ts", F.timestamp_seconds("s"))
    rule = FE.Rule(7200 * FE.SECOND, 600 * FE.SECOND)
    before = {r.id: r.value for r in FE.pit_self(e, "u", "ts", F.sum("v"), rule).collect()}
    cut = rows[40][2] - 600
    moved = e.withColumn("v", F.when(F.col("s") >= cut, F.col("v") + 1000).otherwise(F.col("v")))
    after = {r.id: r.value for r in FE.pit_self(moved, "u", "ts", F.sum("v"), rule).collect()}
    assert all(before[i] == after[i] for i in range(41))
    hist = e.select("u", F.col("ts").alias("hts"), F.col("v").alias("hv"))
    joined = {r.id: r.value for r in FE.pit_join(e, hist, "u", "ts", "hts", F.sum("hv"), rule, "id").collect()}
    assert joined == before
    with pytest.raises(ValueError):
        FE.Rule(5, 5)
    with pytest.raises(ValueError):
        FE.feature_aggregate("collect_list", "x")


def test_bh_matches_the_step_up(spark):
    rng = random.Random(2)
    ps = [rng.random() ** 3 for _ in range(50)]
    d = spark.createDataFrame(list(enumerate(ps)) + [(99, None)], "i int, p double")
    got = {r.i: r.q for r in FS.benjamini_hochberg(d, "p", "i", 80).collect()}
    order = sorted(range(50), key=lambda i: ps[i])
    q, low = {}, 1.0
    for k in range(49, -1, -1):
        low = min(low, ps[order[k]] * 80 / (k + 1))
        q[order[k]] = low
    assert got[99] is None and all(got[i] == pytest.approx(q[i]) for i in q)


def test_ingest_reopens_and_ages(spark):
    s = "sig string, q double, score double, first_seen int, last_seen int, support long, state string, idle int"
    old = spark.createDataFrame([("a", 0.1, 1.0, 1, 1, 1, "EXPIRED", 3), ("b", 0.2, 1.0, 1, 1, 1, "NEW", 2)], s)
    new = spark.createDataFrame([("a", 0.05, 2.0, 5, 5, 2), ("c", 0.3, 1.0, 5, 5, 1)], "sig string, q double, score double, first_seen int, last_seen int, support long")
    got = {r.sig: (r.q, r.support, r.state, r.idle) for r in FS.ingest(old, new, "sig", None).collect()}
    assert got == {"a": (0.05, 3, "REOPENED", 0), "b": (0.2, 1, "NEW", 3), "c": (0.3, 1, "NEW", 0)}
    assert {r.sig: r.state for r in FS.expire_stale(FS.ingest(old, new, "sig", None)).collect()}["b"] == "EXPIRED"


def test_easter_and_calendars(spark):
    assert [str(CX.easter(y)) for y in (2024, 2025, 2019)] == ["2024-03-31", "2025-04-20", "2019-04-21"]
    assert [str(CX.easter(y, True)) for y in (2024, 2023)] == ["2024-05-05", "2023-04-16"]
    assert str(CX.nth_weekday(2024, 5, 0, -1)) == "2024-05-27"
    h = CX.holidays(spark, ["US"], range(2022, 2023))
    c = {str(r.day): r for r in CX.business_calendar(spark, "2022-01-01", "2022-12-31", h).collect()}
    assert not c["2022-12-26"].open and str(c["2022-12-23"].next_open) == "2022-12-27" and c["2022-03-31"].fiscal_end


def test_rank_metrics(spark):
    rng = random.Random(4)
    rows = [(i, rng.randint(0, 1), round(rng.random(), 1)) for i in range(200)]
    d = spark.createDataFrame(rows, "i int, y int, s double")
    pos, neg = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert EV.roc_auc(d, "y", "s").first().auc == pytest.approx(auc)
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    hits, ap = 0, 0.0
    for k, r in enumerate(order, 1):
        hits += r[1]
        ap += r[1] * hits / k
    assert EV.average_precision(d, "y", "s", "i").first()[0] == pytest.approx(ap / len(pos))
    assert EV.roc_auc(d.where("y = 1"), "y", "s").first().auc is None


def test_matrix_profile_finds_the_spike(spark):
    xs = [math.sin(i * math.pi / 4) + (5 if i == 58 else 0) for i in range(60)]
    d = spark.createDataFrame([("a", i, x) for i, x in enumerate(xs)] + [("b", 0, 1.0)], "s string, t int, x double")
    got = D.matrix_profile_findings(d, "s", "t", "x").collect()
    assert any(r.kind == "DISCORD" for r in got if r.s == "a") and [r.kind for r in got if r.s == "b"] == ["THIN"]


def test_trimming_stops_at_enough_peers():
    from sparkvane.functions.kernels import normal_two_sided

    panel = [{"segment": f"s{i}", "m": 0.0} for i in range(6)] + [{"segment": "x", "m": 9.0}]
    test = lambda r, rest: normal_two_sided((r["m"] - sum(o["m"] for o in rest) / len(rest)) * 2)
    assert D.trim_segments(panel, test) == ["x"]


def test_entropy_modes_and_guard(spark):
    assert [DC.access_mode("DIRECT_IDENTIFIER", b) for b in (10, 40)] == ["BLIND", "OPAQUE"] and DC.access_mode("NONE", 0) == "OPEN"
    d = spark.createDataFrame([(1, "a@b.co")], "id int, email string")
    with pytest.raises(PermissionError):
        DC.guard_columns(d, {"email"})
    assert DC.guard_columns(d.select("id"), {"email"}).count() == 1
    assert DC.backstop(d, ["email"]).count() == 1
    g = d.select(DC.guardrail(F.lit(None).cast("int"), "gt", 3).alias("x"), DC.guardrail(F.col("id"), "gt", 3).alias("y")).first()
    assert g.x and not g.y
    assert DC.schema_names(d, "OPAQUE").columns == ["column_0", "column_1"]
    v = DC.noisy_quantile([1, 2, 3, 4, 100], 0.5, 50.0, 0, 200, 0.5, 0.5)
    assert 2 <= v <= 4


def test_egress_gate(spark):
    rel = spark.createDataFrame([("a", 5), ("b", 50)], "seg string, n long")
    led = spark.createDataFrame([(1, "s", ["a"], 100), (2, "s", ["a", "b"], 95)], "release_id int, scope string, predicates array<string>, n long")
    assert DC.EgressGate().check(rel, led, set()) == {"small_cells": 1, "differencing": 1, "backstop": 0}


class _Max(P.Sketch):
    def identity(self):
        return -(1 << 62)

    def of(self, values):
        return max(values, default=self.identity())

    def merge(self, a, b):
        return max(a, b)

    def encode(self, s):
        return str(s).encode()

    def decode(self, b):
        return int(b)


def test_sketch_plugin(spark):
    P.check_laws(_Max(), [[], [1, 2], [5], [3, 3]])
    d = spark.createDataFrame([("a", 1), ("a", 9), ("b", 4), ("b", None)], "g string, x long").repartition(3)
    got = {r.g: bytes(r.state) for r in P.run_sketch(d, "x", _Max(), ["g"]).collect()}
    assert got == {"a": b"9", "b": b"4"}

    class Bad(_Max):
        def merge(self, a, b):
            return a - b

    with pytest.raises(ValueError):
        P.check_laws(Bad(), [[1], [2]])
    assert P.compatible("1.2.0", "1.1.9") and not P.compatible("2.0.0", "1.0.0")


def test_sources(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,x\n2,y\n")
    assert R.load_raw(spark, str(tmp_path / "x.csv")).count() == 2
    assert [R.read_class(p) for p in ("a.parquet", "b.avro", "c.txt")] == ["data", "metadata", "other"]
    spark.range(100).selectExpr("id", "id * 2 as b").coalesce(1).write.parquet(str(tmp_path / "t"))
    (f,) = R.footers(str(tmp_path / "t"))
    assert f.rows == 100 and 0 < f.projected_bytes(["id"]) < f.projected_bytes(["id", "b"]) <= f.bytes
    p = {r.column: r for r in R.footer_profile(spark, str(tmp_path / "t")).collect()}
    assert (p["b"].hi, p["id"].rows, p["id"].nulls) == (198.0, 100, 0)
    R.export_ndjson(spark.range(2), str(tmp_path / "nd"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "nd")).collect()) == ['{"id":0}', '{"id":1}']
    R.save_states(spark.createDataFrame([(b"x",)], "state binary"), str(tmp_path / "st"), "p1", "s1")
    assert spark.read.parquet(str(tmp_path / "st")).first().snapshot_id == "s1"
    assert R.jdbc_options("postgres", "jdbc:postgresql://h/d", "t")["pushDownAggregate"] == "true"
    assert R.markdown([{"a": 1, "b": "x|y"}]) == "| a | b |\n| --- | --- |\n| 1 | x\\|y |\n"
    v = R.safe_view(spark.createDataFrame([(1, "s")], "id int, payload string"), ["payload"], "safe")
    assert v.columns == ["id"] and spark.table("safe").count() == 1


def test_synthetic_is_repeatable(spark):
    cols = [R.SyntheticColumn("c", "categorical", ("x", "y")), R.SyntheticColumn("n", "normal", mean=5.0), R.SyntheticColumn("k", "identifier", prefix="u")]
    a, b = R.synthetic(spark, cols, 500, 3), R.synthetic(spark, cols, 500, 3).repartition(7)
    assert FS.reproduces(a, b)
    assert abs(a.agg(F.avg("n")).first()[0] - 5) < 0.2
    two = R.commits(spark, cols, [(10, {}), (20, {"c": R.SyntheticColumn("c", "categorical", ("z",))})])
    assert {(r.snapshot_id, r.c) for r in two.select("snapshot_id", "c").distinct().collect() if r.snapshot_id == 1} == {(1, "z")}


def test_stream_is_idempotent_and_late_rows_count(spark, tmp_path):
    d = spark.createDataFrame([(i, 1_700_000_000 + 60 * i) for i in range(30)], "k int, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    d.where("k < 20").coalesce(1).write.parquet(str(tmp_path / "in"))
    part = lambda b: b.groupBy(F.window("ts", "10 minutes").start.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    args = (part, str(tmp_path / "store"), str(tmp_path / "ck"))
    assert SS.advance(SS.open_stream(spark, str(tmp_path / "in"), d.schema), *args) == 1
    assert SS.advance(SS.open_stream(spark, str(tmp_path / "in"), d.schema), *args) == 0
    d.where("k >= 20").unionAll(d.where("k = 0")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert SS.advance(SS.open_stream(spark, str(tmp_path / "in"), d.schema), *args) == 1
    got = SS.merged(spark, str(tmp_path / "store"), lambda s: s.groupBy("w").agg(F.sum("n").alias("n")))
    want = d.unionAll(d.where("k = 0")).groupBy(F.window("ts", "10 minutes").start.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    assert FS.reproduces(got, want)


def test_plans_keep_to_few_shuffles(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    text = A.null_rate(e, ["value", "event_type"])._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "props" not in text


def test_benjamini_hochberg_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(FS, "BLOCK", 50)
    rows = [(i, None if i % 97 == 0 else (i * 7919 % 613) / 613.0 * (i % 3 + 1) / 3) for i in range(2000)]
    d = FS.benjamini_hochberg(spark.createDataFrame(rows, "i long, p double"), "p", "i")
    seen = sorted((p, i) for i, p in rows if p is not None)
    want, least = {i: None for i, p in rows if p is None}, 1.0
    for k in range(len(seen), 0, -1):
        p, i = seen[k - 1]
        want[i] = least = min(least, p * len(seen) / k)
    got = {r.i: r.q for r in d.collect()}
    assert got.keys() == want.keys() and all((got[i] is None) == (q is None) and (q is None or abs(got[i] - q) < 1e-12) for i, q in want.items())
    specs = re.findall(r"windowspecdefinition\((\w+)", d._jdf.queryExecution().optimizedPlan().toString())
    assert specs and set(specs) == {"__b"}  # every window is of a range, or of one row a range


def test_benjamini_hochberg_grows_with_the_family(spark):
    ps = [1.0 if i % 2 else i / 4000 for i in range(4000)] + [float("nan")]
    d = FS.benjamini_hochberg(spark.createDataFrame(list(enumerate(ps)), "i long, p double"), "p", "i", 5000)
    text = d._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedfollowing" not in text  # such a frame is quadratic in its rows
    assert "row_number" not in text  # equal p are ranked once, so a tie isn't one task
    seen, want, least = sorted((1e9 if p != p else p, i) for i, p in enumerate(ps)), {}, 1.0
    for k in range(len(seen), 0, -1):
        p, i = seen[k - 1]
        want[i] = least = min(least, p * 5000 / k)
    assert {r.i: r.q for r in d.collect()} == pytest.approx(want)
