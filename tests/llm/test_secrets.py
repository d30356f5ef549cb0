import hashlib
import random
import re

from sparkvane.llm import secrets as m

PLAIN = [
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    r"AKIA[A-Z0-9]+",
    r"[0-9a-f]+",
]


def brute(text):
    out = []
    for k, p in enumerate(PLAIN):
        for x in re.finditer(p, text or ""):
            if len(x[2] if k == 0 else x[0]) >= (12, 18, 16)[k]:
                out.append((x.start(), k, x.end()))
    return sorted(out)


def rows():
    rng = random.Random(7)
    al = ["token", "ToKen", "paſſword", "password", "toKen", "api_key", "APIKEY", "secret", ":", "=", " ", "'", '"', "abc", "0123456789ab", "é", "AKIA", "ZZ9", "ABCDEFGHIJKLMN", "deadbeef", "q", "="]
    out = [(i, "".join(rng.choice(al) for _ in range(rng.randint(0, 25)))) for i in range(600)]
    return [*out, (900, None), (901, ""), (902, out[3][1]), (902, out[3][1]), (902, "other token=abcdefghijklmnop"), (None, "token: abcdefghijklm1"), (903, "f" * 200000), (904, "ghp_" + "g1" * 18 + " x")]


def test_base_and_ledger(spark, tmp_path):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as blob", "2 as spans", "'x' as rule")
    led = str(tmp_path / "ledger")
    got = m.find_secrets(df, led).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, [tuple(s) for s in r.spans if s.k < 3]) for r in got), key=key) == sorted(((i, brute(t)) for i, t in data), key=key)
    assert [s.k for r in got if r.doc_id == 904 for s in r.spans] == [4]
    blobs = {hashlib.sha256((t or "").encode()).hexdigest() for _, t in data}
    table = spark.read.parquet(led)
    assert table.count() == 2 * len(blobs) == table.select("blob", "rule").distinct().count()
    # a second version of the table: only new texts and new rule versions are scanned
    seen = spark.sparkContext.accumulator(0)

    def counted(text):
        seen.add(1)
        return m.base_spans(text)

    more = df.select("doc_id", "text").unionAll(spark.createDataFrame([(7000, "token=zzzzzzzzzzzzzz"), (7001, data[0][1])], "doc_id long, text string"))
    again = m.find_secrets(more, led, {"base:1": counted, "provider:1": m.provider_spans}).collect()
    assert seen.value == 1 and len(again) == len(data) + 2
    assert spark.read.parquet(led).count() == 2 * len(blobs) + 2
    m.find_secrets(more, led, {"base:2": counted, "provider:1": m.provider_spans}).collect()
    assert seen.value == 1 + len(blobs) + 1


def test_second_run_scans_nothing(spark, tmp_path):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string")
    led = str(tmp_path / "ledger")
    first = m.find_secrets(df, led)
    want = sorted(map(str, first.collect()))

    def never(text):
        raise AssertionError("scanned again")

    again = m.find_secrets(df, led, {"base:1": never, "provider:1": never})
    assert sorted(map(str, again.collect())) == want


def test_many_unseen_blobs(spark, tmp_path, monkeypatch):
    """Past the bound of the broadcasts, texts are shuffled and the findings are the same."""
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    want = sorted(map(str, m.find_secrets(df, str(tmp_path / "a")).collect()))
    cut = sorted(map(str, m.mask_secrets(df, str(tmp_path / "a")).collect()))
    monkeypatch.setattr(m, "FEW", 3)
    monkeypatch.setattr(m, "SPANS", 3)
    assert sorted(map(str, m.find_secrets(df, str(tmp_path / "b")).collect())) == want
    assert sorted(map(str, m.mask_secrets(df, str(tmp_path / "c")).collect())) == cut


def test_columns_with_inner_names(spark, tmp_path):
    df = spark.createDataFrame([(1, "token=abcdefghijklmnop", "p", "q", "r", "s")], "doc_id long, text string, own string, blob string, cut string, __secret_own string")
    got = m.mask_secrets(df, str(tmp_path / "l")).first()
    assert tuple(got) == (1, "[SECRET]", "p", "q", "r", "s")


def test_mask(spark, tmp_path):
    df = spark.createDataFrame([(1, "é token=abcdefghijklmnop end", 5), (1, "clean", 9), (2, None, None), (3, "x 0123456789abcdef0 y", 1)], "doc_id long, text string, n_chars long")
    got = {(r.doc_id, r.text, r.n_chars) for r in m.mask_secrets(df, str(tmp_path / "l")).collect()}
    assert got == {(1, "é [SECRET] end", 14), (1, "clean", 9), (2, None, None), (3, "x [SECRET] y", 12)}


def test_digest_and_empty(spark, tmp_path):
    spark.createDataFrame(rows()[:50], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in m.op10_secrets(spark, str(tmp_path)).collect():
        b = brute(rows()[r.doc_id][1])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{m.KINDS[k]}:{s}:{e}" for s, k, e in b).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in b) for i in range(3))
    none = spark.createDataFrame([], "doc_id long, text string")
    assert m.find_secrets(none, str(tmp_path / "e")).count() == 0
