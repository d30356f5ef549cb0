import random
import zlib
from collections import Counter

import numpy as np
import pytest

from sparkvane.llm import langid as m


def brute_grams(text):
    t = "".join(c if c.isalpha() else " " for c in " " + text.lower() + " ")
    return [t[i - 1 : i + 2] for i in range(1, len(t) - 1) if t[i] != " "]


def name(key):
    return "".join(chr(int(key) >> s & 0x1FFFFF) for s in (42, 21, 0))


def texts():
    rng = random.Random(3)
    small = ["".join(rng.choice("abAß .1\n") for _ in range(rng.randint(0, 30))) for _ in range(40)]
    wide = ["".join(chr(rng.choice([rng.randrange(97, 123), rng.randrange(0x4E00, 0x9000), 0x1F600, 0x130])) for _ in range(40)) for _ in range(20)]
    return small, [*small, *wide, None, "", "1 2 3", "x"]


def test_grams_are_those_of_the_text():
    for ts in texts():
        g = m.Grams(ts)
        ends = [*g.doc.tolist(), len(g.codes)]
        for i, t in enumerate(ts):
            assert [name(g.keys[c]) for c in g.codes[ends[i] : ends[i + 1]]] == brute_grams(t or "")
            assert bool(g.has_letter[i]) == any(c.isalpha() for c in t or "")


def test_filter_against_sets():
    ts = texts()[1]
    grams = sorted({g for t in ts for g in brute_grams(t or "")})
    key = lambda g: ord(g[0]) << 42 | ord(g[1]) << 21 | ord(g[2])
    rng = random.Random(1)
    langs = [f"l{i:02}" for i in range(70)]  # more than one mask word
    own = [(i, key(g)) for i in range(70) for g in grams if rng.random() < 0.2]
    f = m.BitSlicedFilter(langs, own)
    masks = f.masks(np.array([key(g) for g in grams]))
    have = {(i, key(g)) for i in range(70) for k, g in enumerate(grams) if int(masks[i // 64, k]) >> (i % 64) & 1}
    assert set(own) <= have
    assert len(have - set(own)) <= 0.02 * 70 * len(grams)


def test_accuracy_on_held_out(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = m.predict(docs, m.trained_filter(docs)).join(docs, "doc_id").where(m.is_fold("doc_id", 3)).select("lang", "lang_pred").collect()
    assert sum(a == b for a, b in got) >= 0.97 * len(got) > 0


def test_edges(spark, tmp_path):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "de"), (4, "", None), (5, "123 !", "en"), (6, "the dog", None), (6, "the dog", None), (7, "the " * 50000, "en"), (None, "die katze", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' as lang_pred", "1 as score").write.parquet(str(tmp_path / "documents.parquet"))
    got = m.op9_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[3].lang_pred == by[4].lang_pred == by[5].lang_pred == "und" and by[3].score == 0
    assert all(0 <= r.score <= 1 for r in got)
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert m.train(none) == ([], [])
    one = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert m.predict(one, m.BitSlicedFilter([], [])).first().lang_pred == "und"


def test_prediction_against_sets(spark, sf):
    """The whole prediction, by exact sets of trigrams and no filter."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.collect()

    counts = {}
    for r in rows:
        if r.lang and r.text and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            counts.setdefault(r.lang, Counter()).update(brute_grams(r.text))
    sets = {k: {g for g, n in c.items() if n >= m.SHARE * sum(c.values())} for k, c in counts.items()}
    got = {r.doc_id: r for r in m.predict(docs, m.trained_filter(docs)).collect()}
    same = 0
    for r in rows:
        g = brute_grams(r.text or "")
        if not g:
            assert got[r.doc_id].lang_pred == "und" and got[r.doc_id].score == 0
            continue
        hits = {k: sum(x in s for x in g) for k, s in sets.items()}
        best = max(hits.values())
        p = got[r.doc_id]
        assert hits[p.lang_pred] >= best - max(2, 0.02 * len(g))
        assert abs(p.score - best / len(g)) < 0.1
        same += hits[p.lang_pred] == best
    assert same >= 0.98 * len(rows)


def test_stage_keeps_an_unlabelled_corpus(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "... 12", None), (3, None, "en")], "doc_id long, text string, lang string")
    assert [r.doc_id for r in m.keep_known(docs, m.trained_filter(docs)).collect()] == [1]


def test_stage_fills_the_language_and_rejects_the_unknown(spark):
    seen = [(i, "the words of the other side are here and there", "en") for i in range(20)]
    docs = spark.createDataFrame([*seen, (30, "here the other words are", None), (31, "каждый охотник желает знать", "en"), (32, "qzx xqz zxq vvkq", None)], "doc_id long, text string, lang string")
    langs, grams, learned = m._train(docs.where("doc_id < 20"))
    assert learned == 20 * len(brute_grams(seen[0][1]))
    assert m.keep_known(docs, m.BitSlicedFilter(langs, grams, learned)).count() == 23  # too little was seen to reject
    got = {r.doc_id: r.lang for r in m.keep_known(docs, m.BitSlicedFilter(langs, grams, m.ENOUGH)).collect()}
    assert got == {**{i: "en" for i in range(20)}, 30: "en"}


def test_rejection_has_no_switch_by_what_was_learned(spark):
    """One trigram more or less learned decides on no text but by a hair of its score: a text in
    no known language goes under either, one of a score near REJECT stays under either."""
    langs, grams, _ = m._train(spark.createDataFrame([(i, "the words of the other side are here and there", "en") for i in range(20)], "doc_id long, text string, lang string"))
    alien, near = "каждый охотник желает знать", "the каждый охотник желает знать где"
    docs = spark.createDataFrame([(1, alien, None), (2, near, None)], "doc_id long, text string, lang string")
    score = {r.doc_id: r.score for r in m.predict(docs, m.BitSlicedFilter(langs, grams)).collect()}
    assert score[1] < 0.02 and m.least_share(m.ENOUGH) < score[2] < m.REJECT
    for learned in (m.ENOUGH // 10, m.ENOUGH - 1, m.ENOUGH):
        assert [r.doc_id for r in m.keep_known(docs, m.BitSlicedFilter(langs, grams, learned)).collect()] == [2]
    shares = [m.least_share(n) for n in range(1, 200_000)]
    assert all(0 <= b - a < 1e-3 for a, b in zip(shares, shares[1:]) if b > 0) and shares[-1] < m.REJECT
    assert m.least_share(0) == 0


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(m, "LANGUAGES", 2)
    docs = spark.createDataFrame([(i, "abc def", f"l{i}") for i in range(3)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        m.train(docs)
