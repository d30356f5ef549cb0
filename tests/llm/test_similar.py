import random

import corpus_pipeline
from sparkvane.llm import similar as m


def sets(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute(rows):
    """Rows that stay, by all pairs."""
    s, root = [sets(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r)
    return sorted(min((i is None, i or 0) for i, _ in g) for g in groups.values())


def rows():
    rng = random.Random(7)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randint(1, 120))) for _ in range(40)]
    base = [b + " the same long footer stands under every other text here" * (k % 2) for k, b in enumerate(base)]
    out = list(enumerate(base))
    for i in range(200):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(3)}"
        out.append((100 + i, " ".join(w)))
    return [*out, (400, None), (401, ""), (402, "one two"), (403, "One  two"), (404, "word " * 30000)]


def test_against_all_pairs(spark, monkeypatch):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as node", "2 as root", "3 as n").repartition(3)
    want = brute(data)
    for seen, sample in ((m.SEEN, m.SAMPLE), (3, 1)):  # without and with hot shingles
        monkeypatch.setattr(m, "SEEN", seen)
        monkeypatch.setattr(m, "SAMPLE", sample)
        got = m.keep_one(df)
        assert got.columns == df.columns
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == want
    assert m.keep_one(df.limit(0)).count() == 0


def test_the_stage_takes_near_copies_out(spark):
    w = [f"v{i}" for i in range(200)]
    near, far = [*w], [*w]
    near[50] = near[120] = "x"
    for k in range(5, 200, 20):
        far[k] = "y"
    df = spark.createDataFrame([(2, " ".join(near)), (1, " ".join(w)), (3, " ".join(far))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == [1, 3]


def test_null_and_repeated_ids_are_documents(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(30)) for c in "xyz")
    df = spark.createDataFrame([(1, x), (1, y), (None, z), (None, z), (2, x + " q"), (1, x)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.text) for r in corpus_pipeline.near_dedup(spark, df, "").collect())
    assert got == [(0, z), (1, x), (1, y)]


def test_many_to_drop_and_clashing_names(spark, monkeypatch):
    data = [*rows(), (7000, "again and again and again the same"), (7000, "again and again and again the same")]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as __node", "2 as __keep_id", "3 as node", "4 as c0", "5 as id1").repartition(3)
    want = [*brute(data[:-1])]
    monkeypatch.setattr(m, "FEW", 2)
    got = m.keep_one(df)
    assert got.columns == df.columns
    out = got.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == want
    assert {(r["__node"], r["__keep_id"], r.node, r.c0, r.id1) for r in out} == {(1, 2, 3, 4, 5)}
    assert dict((r.doc_id, r.text) for r in out) == {i: t for i, t in data if (False, i) in want}


def test_hot_shards_are_cut(spark, monkeypatch):
    """Blocks of a few texts give the same groups as whole shards."""
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(m, "HOT", 3)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in m.keep_one(df).collect()) == brute(data)


def test_reach_misses_next_to_nothing():
    for n in (1, 4, 5, 20, 330, 5000):
        sure = n - -(-4 * n // 5) + 1
        assert m.reach(n, 0) == m.reach(n, n // 4) == sure
        for cold in range(n // 4 + 1, n + 1):
            k = m.reach(n, cold)
            assert k == sure or (n / 4 / cold) ** k <= 1.01e-12
