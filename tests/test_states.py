import pytest
from pyspark.sql import functions as F

from sparkvane.operators import replay as RP
from sparkvane.operators import states as ST
from sparkvane.plans import catalog
from sparkvane.sources import puffin as PF


def test_envelopes_open_only_as_what_they_are(spark):
    d = spark.createDataFrame([(1, bytearray(b"abc\x00")), (2, bytearray(b"")), (3, None)], "i int, s binary")
    sealed = d.select("i", ST.seal(F.col("s"), "theta", lg_k=12).alias("e")).cache()
    assert {r.i: r.s and bytes(r.s) for r in sealed.select("i", ST.unseal(F.col("e"), "theta", lg_k=12).alias("s")).collect()} == {1: b"abc\x00", 2: bytearray(b""), 3: None}
    assert sealed.select(ST.describe(F.col("e"))).first()[0] == '{"kind":"theta","params":{"lg_k":12}}'
    for kind, params in (("theta", {"lg_k": 11}), ("hll", {"lg_k": 12}), ("theta", {})):
        with pytest.raises(Exception, match="no state of"):
            sealed.select(ST.unseal(F.col("e"), kind, **params)).collect()
    broken = sealed.where("i = 1").select(F.concat(F.expr("substring(e, 1, length(e) - 1)"), F.lit(b"z")).alias("e"))
    with pytest.raises(Exception, match="damaged"):
        broken.select(ST.unseal(F.col("e"), "theta", lg_k=12)).collect()


def test_states_of_other_parameters_do_not_merge(spark):
    d = spark.range(100).select("id")
    a = d.agg(F.hll_sketch_agg("id", 12).alias("s")).select(ST.seal(F.col("s"), "hll", lg_k=12).alias("s"))
    b = d.agg(F.hll_sketch_agg("id", 10).alias("s")).select(ST.seal(F.col("s"), "hll", lg_k=10).alias("s"))
    n = ST.merge_sealed(a.unionAll(a), "s", "hll", lg_k=12).select(F.hll_sketch_estimate(ST.unseal(F.col("s"), "hll", lg_k=12))).first()[0]
    assert abs(n - 100) <= 3
    with pytest.raises(Exception, match="no state of"):
        ST.merge_sealed(a.unionAll(b), "s", "hll", lg_k=12).collect()


def test_edges_do_not_collide(spark):
    rows = [("a|b", "c"), ("a", "b|c"), ("a>1:b", "c"), ("a", "b>1:c"), ("", ""), ("1", ":"), ("1:", "")]
    d = spark.createDataFrame(rows, "s string, t string")
    assert d.select(ST.edge_key(F.col("s"), F.col("t")).alias("k")).distinct().count() == len(rows)
    assert d.select(ST.edge_key(F.lit(None).cast("string"), F.col("t"))).first()[0] is None


def test_effective_n(spark):
    d = spark.createDataFrame([(0,), (100,), (10**9,)], "n long").select(ST.effective_n(F.col("n"), 0.0).alias("exact"), ST.effective_n(F.col("n"), 0.01).alias("kll")).collect()
    assert [round(r.exact) for r in d] == [0, 100, 10**9]
    assert d[1].kll < 100 and abs(d[2].kll - 0.09 / 0.002**2) < 1


def test_statistics_files(spark, tmp_path):
    assert PF.parse(PF.compose([])) == []
    for bad in (b"", b"PFA1" * 3, PF.compose([{"type": "x", "blob": b"1"}])[:-1], PF.compose([])[:-8] + b"\x01\0\0\0" + b"PFA1"):
        with pytest.raises(ValueError):
            PF.parse(bad)
    s = spark.createDataFrame([([1], 7, 3, {"ndv": "2"}, bytearray(b"ab")), ([2, 3], 7, 3, None, bytearray(b""))], "fields array<int>, snapshot_id long, sequence_number long, properties map<string,string>, blob binary")
    path = str(tmp_path / "a.stats")
    assert PF.write_puffin(s, path) == 2
    got = sorted(((r.fields, r.snapshot_id, r.properties, bytes(r.blob), r.type) for r in PF.read_puffin(spark, path).collect()), key=str)
    assert got == [([1], 7, {"ndv": "2"}, b"ab", PF.THETA), ([2, 3], 7, {}, b"", PF.THETA)]
    assert PF.write_puffin(s.limit(0), path) == 0 and PF.read_puffin(spark, path).count() == 0


def test_replay_sees_no_future(spark):
    steps = spark.sql("select explode(array(timestamp'2024-01-02', timestamp'2024-01-01', timestamp'2024-01-03')) as now")
    facts = spark.sql("select explode(array(timestamp'2023-05-01', timestamp'2024-01-01', timestamp'2024-01-01 00:00:01', timestamp'2025-01-01', cast(null as timestamp))) as t")
    out = RP.replay(steps, "now", {"f": (facts, "t", [F.count(F.lit(1)).alias("n")])}).orderBy("step").collect()
    assert [(r.step, r.n) for r in out] == [(0, 2), (1, 3), (2, 3)]
    assert RP.replay(steps.limit(0), "now", {"f": (facts, "t", [F.count(F.lit(1)).alias("n")])}).count() == 0


@pytest.fixture(scope="module")
def many_users(spark, tmp_path_factory):
    """More users than a state of 2^14 counts exactly, each twice, and a type of NULL."""
    d = str(tmp_path_factory.mktemp("many"))
    e = spark.range(60_000).selectExpr("id as event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(cast(id % 3 as int)) as ts", "id % 30000 as user_id", "if(id % 30000 < 700, null, if(id % 30000 < 5000, 'few', 'many')) as event_type", "1D as value")
    e.write.parquet(d + "/events.parquet")
    return d


def test_sealed_states_beyond_a_sketch(spark, many_users):
    got = {r.event_type: (r.users, r.header, r.oracle) for r in catalog.queries()["sealed_states"](spark, many_users).collect()}
    head = '{"kind":"theta","params":{"lg_k":14}}'
    assert got == {None: (700, head, True), "few": (4300, head, False), "many": (25_000, head, False)}


def test_statistics_file_beyond_a_sketch(spark, many_users, tmp_path):
    got = {r.event_type: r.users for r in catalog.queries()["statistics_file"](spark, many_users).collect()}
    assert got == {None: 700, "few": 4300, "many": 25_000}
    s = spark.range(50).agg(F.theta_sketch_agg("id", 14).alias("blob")).selectExpr("array(1) as fields", "1L as snapshot_id", "1L as sequence_number", "map('ndv', '7') as properties", "blob")
    PF.write_puffin(s, str(tmp_path / "b.stats"))
    assert PF.read_puffin(spark, str(tmp_path / "b.stats")).select(PF.distinct_values()).first()[0] == 50  # no count: the estimate


def test_future_knowledge_without_ids(spark):
    """Findings without a baseline or a snapshot are right, and don't meet in one task."""
    at = "timestamp'2024-01-01' + make_dt_interval(cast({} as int))"
    snapshots = spark.range(1000).selectExpr("id as snapshot_id", f"{at.format('id % 10')} as committed_at")
    f = spark.range(4000).selectExpr("id as finding_id", f"{at.format(5)} as now", "if(id % 2 = 0, id % 1000, null) as snapshot_id", "if(id % 2 = 1, id % 1000, null) as baseline_id", f"{at.format(6)} as created_at")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(kept, ("false", "-1")):
            spark.conf.set(k, v)
        for part, want in (("snapshot_id is null", lambda i: "SNAPSHOT"), ("baseline_id is null", lambda i: "CREATED" if i % 10 <= 5 else "SNAPSHOT")):
            rows = RP.future_knowledge(f.where(part), snapshots).select("finding_id", "reason", F.spark_partition_id().alias("task")).collect()
            assert len(rows) == 2000 and all(r.reason == want(r.finding_id) for r in rows)
            assert len({r.task for r in rows}) == 4
        both = f.select("finding_id", "now", F.lit(7).cast("long").alias("snapshot_id"), "baseline_id", "created_at").withColumn("now", F.lit("2024-01-09").cast("timestamp"))
        got = {r.finding_id: r.reason for r in RP.future_knowledge(both, snapshots).collect()}
        assert got == {i: "BASELINE" for i in range(4000) if i % 2 and i % 10 == 9}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
