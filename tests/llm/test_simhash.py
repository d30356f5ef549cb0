import random

import xxhash
from pyspark.sql import Row

from sparkvane.llm.simhash import BKTree, keep_one, near_duplicates, near_links


def brute_fp(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    g = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if len(w) >= 3 else [" ".join(w)]
    hs = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    fps = [(i, brute_fp(t)) for i, t in rows]
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(fps):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, f"{f:016x}", least[find(k)]) for k, (i, f) in enumerate(fps))


def test_against_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("alpha Beta gämma delta eps\tzeta\n".split(" ")) for _ in range(rng.randint(1, 60))) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(60):
        w = rng.choice(base).split(" ")
        w[rng.randrange(len(w))] = "changed"
        rows.append((100 + i, " ".join(w)))
    rows += [(300, None), (301, ""), (302, " \n"), (303, base[0]), (303, base[0]), (304, "one"), (305, "word " * 70000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as fp", "1 as component_id")
    got = sorted(tuple(r)[:3] for r in near_duplicates(df).collect())
    assert got == brute(rows)
    kept = sorted(r.doc_id for r in keep_one(df).collect())
    assert kept == sorted({c for *_, c in got})


def test_links_span_all_within_radius(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for x in list(fps):
        for _ in range(4):
            x ^= 1 << rng.randrange(64)
            fps.add(x)
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([Row(fp=sign(x)) for x in fps])
    for hot in (4096, 3):
        import sparkvane.llm.simhash as m

        old, m.HOT = m.HOT, hot
        try:
            links = {(r.u, r.v) for r in near_links(df).collect()}
        finally:
            m.HOT = old
        for u, v in links:
            assert ((u ^ v) & (1 << 64) - 1).bit_count() <= 2
        root = {sign(x): sign(x) for x in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for u, v in links:
            root[find(u)] = find(v)
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 2:
                    assert find(sign(a)) == find(sign(b))


def test_tree_is_exact():
    rng = random.Random(1)
    xs = [rng.getrandbits(10) for _ in range(300)]
    t = BKTree()
    for x in xs:
        t.add(x)
    for q in xs[:40]:
        assert sorted(t.within(q, 2)) == [i for i, x in enumerate(xs) if (x ^ q).bit_count() <= 2]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).count() == 0 and keep_one(df).count() == 0
