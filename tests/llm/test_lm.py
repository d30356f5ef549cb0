import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from sparkvane.llm import lm as m


def toks(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "</end>"]


def rows():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)] + ["É", "É\xa0x", "Q"]
    out = [(i, " ".join(rng.choice(words[: rng.randint(3, 33)]) for _ in range(rng.randint(0, 40)))) for i in range(200)]
    return [*out, (500, None), (501, ""), (502, " \n"), (503, out[1][1]), (503, out[1][1]), (504, "w1 " * 20000), (None, "w2 new")]


def brute(data):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(t for i, x in data if not held(i) for t in toks(x))
    n, v = sum(c.values()), len(c)
    return sorted(
        ((i is None, i or 0, held(i), len(toks(x)), sum(c[t] > 0 for t in toks(x)), n, round(sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in toks(x)), 6)) for i, x in data)
    )


def test_base_against_brute_force(spark, tmp_path):
    data = rows()
    spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as row", "2 as score", "3 as n").write.parquet(str(tmp_path / "documents.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for head in (m.HEAD, 5, 0):  # all in the broadcast, some, none
        got = m.score_documents(df, m.is_fold("doc_id", 5), head_size=head, buckets=8).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == brute(data)
        assert all(r.score <= 0 for r in got)


def test_filter_reads_quantised_counts():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 63, 20000).astype(np.uint64))
    counts = np.minimum(rng.zipf(1.5, len(keys)), 100000)
    seg = m.segment(keys, counts, 1 << 30)
    one = m.LogBloom(np.frombuffer(seg, np.uint8), np.zeros((2, 1), np.int64), np.full((2, 1), 8 * len(seg)), 1, 1, 1)
    got = one.read(1, keys)
    want = m.level_count(m.levels(counts))
    assert (got >= want).all() and (got == want).mean() > 0.93 and (want <= counts).all()
    other = rng.integers(0, 1 << 63, 20000).astype(np.uint64)
    assert (one.read(1, other) > 0).mean() < 0.1


def test_a_familiar_text_scores_higher(spark):
    docs = [(i, "the cat sat on the mat and the dog ran off") for i in range(50)] + [(1000, "the cat sat on the mat"), (1001, "mat the on sat cat the")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in m.score_documents(df, df.doc_id >= 1000, buckets=4).where("doc_id >= 1000").collect()}
    assert got[1000].score > got[1001].score and got[1000].score > got[1000].base_score


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert m.score_documents(df, m.is_fold("doc_id", 5)).count() == 0


def exact_score(data, held, bits=None):
    """Scores by exact counts, quantised."""
    def q(c):
        return float(m.level_count(m.levels(np.array([c])))[0]) if c else 0.0

    one, two = Counter(), Counter()
    for i, x in data:
        if not held(i):
            w = toks(x)
            one.update(w)
            two.update(zip(["</end>", *w], w))
    n, v = sum(one.values()), len(one)
    out = []
    for i, x in data:
        w = toks(x)
        s = 0.0
        for h, t in zip(["</end>", *w], w):
            cw = q(one[t])
            s += math.log10(min(q(two[h, t]), cw) + m.MU * (cw + 0.5) / (n + 0.5 * (v + 1))) - math.log10(q(one[h]) + m.MU)
        out.append((i is None, i or 0, round(min(0.0, s), 6)))
    return sorted(out)


def test_score_against_exact_counts_in_one_pass_and_in_many(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    want = exact_score(data, held)
    for size in (m.PASS_BYTES, 3000, 1):  # one pass, some, one for each pair of segments
        out = m.score_documents(df, m.is_fold("doc_id", 5), buckets=4, pass_bytes=size, bits_per_entry=256)
        got = out.collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, round(r.score, 6)) for r in got) == want
        assert all(0 <= r.filter_false_rate < 1e-4 for r in got)
    counted = m.count_ngrams(df, buckets=4)
    assert len(m.passes(counted, 1)) == 16 and len(m.passes(counted)) == 1


def test_bits_an_entry_do_not_depend_on_the_number():
    rng = np.random.default_rng(3)
    for n in (2000, 200000):
        keys = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        seg = m.segment(keys, np.ones(len(keys), np.int64))
        assert 7.5 < 8 * len(seg) / len(keys) < 8.5
        one = m.LogBloom(np.frombuffer(seg, np.uint8), np.zeros((2, 1), np.int64), np.full((2, 1), 8 * len(seg)), 1, 1, 1)
        other = rng.integers(0, 1 << 63, 50000).astype(np.uint64)
        assert (one.read(1, other) > 0).mean() < 0.04


def test_texts_are_gone_through_as_often_at_any_size_of_the_filter(spark, monkeypatch):
    """A filter past the limit took a pass over all texts for each part of it."""
    written = []
    real = m.durable
    monkeypatch.setattr(m, "durable", lambda df, **x: written.append(df.columns) or real(df, **x))
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    for buckets in (4, 16):
        written.clear()
        m.score_documents(df, m.is_fold("doc_id", 5), buckets=buckets, pass_bytes=1).collect()
        assert len(written) <= 3


def test_op6_broadcasts_no_filter(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(m, "load", None)
    data = rows()
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = m.op6_lm_scoring(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == brute(data)


def test_chunks_and_a_null_fold(spark):
    """Many chunks, and rows of which it's unknown whether they are held out (not learned from), as by broadcast."""
    df = spark.createDataFrame(rows(), "doc_id long, text string").repartition(5)
    held = m.F.when(df.doc_id % 7 != 0, m.is_fold("doc_id", 5))
    row = lambda r: (r.doc_id is None, r.doc_id or 0, r.held_out is None, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))
    want = sorted(map(row, m.score_documents(df, held, buckets=4).collect()))
    assert sorted(map(row, m.score_in_place(df, held, buckets=4, chunk_tokens=1).collect())) == want
    assert m.score_in_place(df.limit(0), m.is_fold("doc_id", 5)).count() == 0


def test_planes():
    keys = np.unique(np.random.default_rng(5).integers(0, 1 << 64, 1000, np.uint64))
    assert (np.cumsum(m.from_planes(m.planes(m.gaps(keys)), np.uint64), dtype=np.uint64) == keys).all()
    assert len(m.from_planes(m.planes(keys[:0]), np.uint64)) == 0
