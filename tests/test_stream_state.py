from pyspark.sql import functions as F

from sparkvane.streaming import stream as SS


def _drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def _events(spark, path, n=40):
    d = spark.createDataFrame([(i, i % 3, 1_700_000_000 + 300 * i) for i in range(n)], "id int, k int, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    d.coalesce(1).write.mode("overwrite").parquet(path)
    return d


def test_arbitrary_state_counts_over_batches(spark, tmp_path):
    d = _events(spark, str(tmp_path / "a"))
    _events(spark, str(tmp_path / "b"), 10).write.mode("append").parquet(str(tmp_path / "a"))
    s = SS.open_stream(spark, str(tmp_path / "a"), d.schema)
    got = _drain(SS.running_counts(s, "k"), "counts", "update").groupBy("k").agg(F.max("seen").alias("n"))
    assert {r.k: r.n for r in got.collect()} == {0: 18, 1: 16, 2: 16}


def test_windows_on_a_stream_equal_the_batch(spark, tmp_path):
    d = _events(spark, str(tmp_path / "in"))
    n = [F.count(F.lit(1)).alias("n")]
    for name, f in (("tumbling", lambda x: SS.tumbling(x, "ts", "1 hour", n, "1 day")), ("sliding", lambda x: SS.sliding(x, "ts", "2 hours", "1 hour", n, (), "1 day")), ("sessions", lambda x: SS.sessions(x, "ts", "10 minutes", ["k"], n, "1 day"))):
        got = _drain(f(SS.open_stream(spark, str(tmp_path / "in"), d.schema)), name, "complete")
        want = f(d)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), name


def test_stream_stream_join(spark, tmp_path):
    d = _events(spark, str(tmp_path / "in"))
    a = SS.open_stream(spark, str(tmp_path / "in"), d.schema)
    b = SS.open_stream(spark, str(tmp_path / "in"), d.schema).select(F.col("k").alias("k"), F.col("ts").alias("bts"))
    got = _drain(SS.joined(a, b, "k", "ts", "bts", "20 minutes").select("id"), "pairs", "append")
    h = d.select(F.col("k").alias("k2"), F.col("ts").alias("bts"))
    want = d.join(h, (F.col("k") == F.col("k2")) & (F.col("bts") >= F.col("ts")) & (F.col("bts") <= F.col("ts") + F.expr("interval 20 minutes")))
    assert got.count() == want.count() > 40
