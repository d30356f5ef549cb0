import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as p

from . import test_decontaminate, test_secrets, test_simhash


def brute(rows, bench):
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    keep = {c for *_, c in test_simhash.brute(rows)}
    rows = [r for r in rows if r[0] in keep]
    wins = set()
    for _, t in bench:
        w = test_decontaminate.W.findall(test_decontaminate.low(t))
        wins |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9) if w else 0)}
    out = []
    for i, t in rows:
        found = list(re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t))
        w = [test_decontaminate.low(m[0]) for m in found]
        hit = {k + j for x in wins for k in range(len(w) - len(x) + 1) if tuple(w[k : k + len(x)]) == x for j in range(len(x))}
        gone, k = set(), 0
        while k < len(w):
            if k in hit:
                e = k
                while e in hit:
                    e += 1
                stop = found[e - 1].end()
                gone |= set(range(found[k].start(), stop + (t[stop : stop + 1] == " ")))
                k = e
            k += 1
        t = "".join(c for j, c in enumerate(t) if j not in gone)
        done, pos = "", 0
        spans = test_secrets.brute(t)
        for s, _, e in spans:
            if s >= pos:
                done += t[pos:s] + "[SECRET]"
            pos = max(pos, e)
        out.append((i, done + t[pos:]))
    return out


def test_against_brute_force(spark, tmp_path):
    docs, bench = test_decontaminate.cases()
    rows = [(i, t) for i, t in dict(docs).items()] + [(200, "1234 ..."), (201, "x token=abcdefghijklmnop y " + docs[4][1]), (202, docs[4][1] + " q"), (203, None), (204, "long " * 9000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = p.run(spark, str(tmp_path)).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in brute(rows, bench):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), 4096)):
            x = ids[s : s + 4096]
            want.append((i, k, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    load = defaultdict(int)
    for r in got:
        load[r.sequence_id] += r.length
    assert max(load.values()) <= 4096


def test_stages_return_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, f in p.STAGES[:-1]:
        new = f(spark, kept, sf)
        assert new.columns == docs.columns and new.dtypes == docs.dtypes, name
        kept = new
    assert 0 < kept.count() <= docs.count()
    empty = docs.limit(0)
    for _, f in p.STAGES:
        assert f(spark, empty, sf).count() == 0


def test_stages_with_nulls_repeats_and_clashing_columns(spark, tmp_path):
    """Extra columns named like inner ones pass through; null ids and texts don't crash."""
    rows = [(1, "the cat sat", None, None, None), (1, "the cat sat", "en", "s", 11), (None, "token=abcdefghijklmnop x", "en", None, 24), (2, None, "en", "s", None), (3, "", None, None, 0), (4, "word " * 40000, "en", "s", 1), (5, "ab " * 9 + "zz", "en", "s", 29)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    extra = ["'x' as fp", "'y' as spans", "1 as blob", "2 as root", "3 as starts", "'q' as __starts2", "4 as rank", "5 as component_id", "6 as rules", "7 as node", "8 as length", "9 as part"]
    docs = spark.createDataFrame(rows, schema).selectExpr("*", *extra)
    spark.createDataFrame([(1, "ab " * 9 + "zz"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = docs
    for name, f in p.STAGES[:-1]:
        kept = f(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
    out = {(r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()}
    assert (1, "the cat sat") in out and (5, "") in out and len([x for x in out if x[0] == 1]) == 1
    assert p.STAGES[-1][1](spark, kept, str(tmp_path)).where("doc_id = 4").count() == 10
