import hashlib
import random
import re

import numpy as np

from sparkvane.llm import decontaminate as m
from sparkvane.llm.fmindex import FMIndex, WaveletMatrix

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, bench):
    wins = {}
    for i, t in bench:
        w = W.findall(low(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, items = W.findall(low(t)), set(), set()
        for p, its in wins.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    items |= its
        out.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def cases():
    rng = random.Random(2)
    v = "The quick bröwn FOX jumps x1 9 ÄB".split()
    bench = [(i, " ".join(rng.choice(v) for _ in range(rng.choice([3, 9, 10, 14, 30])))) for i in range(12)]
    bench += [(50, None), (51, ""), (52, "--- ..."), (3, bench[5][1])]
    docs = []
    for i in range(60):
        parts = [" ".join(rng.choice([*v, "zz", "yy."]) for _ in range(rng.randint(0, 40)))]
        if i % 3 == 0:
            b = rng.choice(bench[:12])[1]
            parts.append(b.upper().replace(" ", ", ") if i % 2 else b)
            parts.append(" ".join(rng.choice(v) for _ in range(5)))
        docs.append((i, " | ".join(parts)))
    docs += [(100, None), (101, ""), (102, bench[0][1]), (102, bench[0][1]), (103, (bench[2][1] + " ") * 500)]
    return docs, bench


def test_against_brute_force(spark, tmp_path):
    docs, bench = cases()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n_words", "'q' as items")
    b = spark.createDataFrame(bench, "item_id long, text string")
    want = brute(docs, bench)
    for block in (1 << 20, 25):  # one block of windows, and several with cut items
        old, m.BLOCK = m.BLOCK, block
        try:
            f = m.find_contamination(d, b)
            got = sorted(tuple(r) for r in f.mapInArrow(m._digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean").collect())
            assert got == want
            cut = {r.doc_id: r.text for r in m.decontaminate(d, b).collect()}
        finally:
            m.BLOCK = old
        for i, t in docs:
            hit = next(x for x in want if x[0] == i)
            assert cut[i] == t if not hit[5] else len(W.findall(low(cut[i]))) == hit[1] - hit[2]


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert m.find_contamination(d, b).count() == 0
    assert m.decontaminate(one, b).first().text == "a b"


def test_index_and_wavelet():
    rng = np.random.default_rng(1)
    text = np.concatenate([np.append(rng.integers(1, 5, rng.integers(1, 30)), 0) for _ in range(20)])
    wm = WaveletMatrix(text, 5)
    for _ in range(50):
        c, i = int(rng.integers(0, 5)), int(rng.integers(0, len(text) + 1))
        assert wm.rank(np.array([c]), np.array([i]))[0] == (text[:i] == c).sum()
    ix = FMIndex(text, 5, sample=4)
    pats = rng.integers(1, 5, (40, 4))
    lens = rng.integers(1, 5, 40)
    rows, lo, hi = ix.search(pats, lens)
    got = {int(r): sorted(ix.locate(np.arange(a, b)).tolist()) for r, a, b in zip(rows, lo, hi)}
    for r in range(40):
        p = pats[r, 4 - lens[r] :]
        want = [k for k in range(len(text) - len(p) + 1) if (text[k : k + len(p)] == p).all()]
        assert got.get(r, []) == want


def test_shards_at_random():
    rng = random.Random(12)
    for _ in range(400):
        v = ["a", "b", "c", "d", "é"][: rng.randint(1, 5)]
        bench = [(i, " ".join(rng.choice(v) for _ in range(rng.randint(0, 14)))) for i in range(rng.randint(0, 4))]
        docs = [(i, rng.choice([None, "", "zz yy"]) if rng.random() < 0.2 else " ".join(rng.choice([*v, "zz"]) for _ in range(rng.randint(0, 40)))) for i in range(rng.randint(0, 6))]
        q = m.compile_windows([(i, m.words_of(t)) for i, t in bench if m.words_of(t)])
        if q is None:
            continue
        got = [(i, n, sum(e - s for s, e in spans), len(its)) for (i, _), (n, spans, its) in zip(docs, m.search_shard([t for _, t in docs], q))]
        assert sorted(got) == [x[:4] for x in brute(docs, bench)]


def test_blocks_cut_items_without_losing_windows():
    rng = random.Random(2)
    for _ in range(200):
        bench = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))) for i in range(rng.randint(0, 5))]
        most = rng.randint(1, 12)
        got, want = set(), set()
        for part in m.blocks(bench, 4, most):
            w = [(i, tuple(x[k : k + 4])) for i, x in part for k in range(max(1, len(x) - 3))]
            assert 0 < len(w) <= most
            got.update(w)
        for i, t in bench:
            x = m.words_of(t)
            want.update((i, tuple(x[k : k + 4])) for k in range(max(1, len(x) - 3) if x else 0))
        assert got == want


def test_columns_with_inner_names(spark):
    extra = ["'u' as __text", "7 as __n_words", "array(0) as __starts", "array(1) as __ends", "array('z') as __items"]
    d = spark.createDataFrame([(1, "a b c", 5), (2, "x y", 3)], "doc_id long, text string, n_chars int").selectExpr("*", *extra)
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    got = sorted(m.decontaminate(d, b).collect())
    assert [(r.doc_id, r.text, r.n_chars) for r in got] == [(1, "c", 1), (2, "x y", 3)]
    assert all((r["__text"], r["__n_words"], r["__starts"], r["__ends"], r["__items"]) == ("u", 7, [0], [1], ["z"]) for r in got)
