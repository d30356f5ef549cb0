import random
import re
import zlib
from collections import Counter, defaultdict

from sparkvane.llm import sharding as m


def brute_capacity(sizes, k):
    def ok(c):
        n, used = 1, 0
        for s in sizes:
            if s > c:
                return False
            if used + s > c:
                n, used = n + 1, 0
            used += s
        return n <= k

    lo, hi = 1, max(1, sum(sizes))
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if ok(mid) else (mid + 1, hi)
    return lo


def bins_of(groups, level):
    by = defaultdict(list)
    for g, s in groups:
        by[g >> (m.WIDTH - level)].append((g, s))
    return [m.Bin(min(x)[0], sum(s for _, s in x), len(x), level) for x in by.values()]


def test_refinement_is_exact():
    rng = random.Random(3)
    for case in range(60):
        n = rng.choice([1, 5, 40, 3000])
        groups = sorted({rng.getrandbits(m.WIDTH if case % 2 else 40): rng.randint(1, 300) for _ in range(n)}.items())
        if case % 3 == 0:
            groups[len(groups) // 2] = (groups[len(groups) // 2][0], 40 * n)  # a third of all in one group
        for k in (1, 3, 8):
            bins = sorted(bins_of(groups, m.FIRST))
            while todo := m.undecided(bins, k):
                level = min(b.level for b in todo)
                todo = [b for b in todo if b.level == level]
                names = {b.first >> (m.WIDTH - level) for b in todo}
                bins = sorted(set(bins) - set(todo) | set(bins_of([x for x in groups if x[0] >> (m.WIDTH - level) in names], level + m.STEP)))
            assert m.least(bins, k, False) == brute_capacity([s for _, s in groups], k)


def test_shards(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdé \n") for _ in range(rng.randint(0, 200))) for _ in range(300)]
    rows = [*enumerate(texts)] + [(1000 + i, "a hot text") for i in range(150)] + [(2000, None), (2001, None), (2002, ""), (2003, "z" * 9000), (5, texts[5]), (5, texts[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as shard", "1 as g", "2 as size")
    got = m.shard(df, 8).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots, at, size, load = defaultdict(list), defaultdict(set), Counter(), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        at[r.g].add(r.shard)
        size[r.g] += r.size
        load[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in at.values()) and set(slots) <= set(range(8))
    assert max(load.values()) <= brute_capacity([s for _, s in sorted(size.items())], 8)


def test_plan_and_files(spark, sf, tmp_path):
    assert not re.search("Python|Pandas|Arrow", m.op8_sharding(spark, sf)._jdf.queryExecution().toString())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    m.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 4


def test_empty(spark):
    assert m.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0
