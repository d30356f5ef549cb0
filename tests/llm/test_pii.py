import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from sparkvane.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        s += x - 9 * (x > 9)
    return s % 10 == 0


def brute(text):
    out = []
    for k, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card" and not (12 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def rows():
    rng = random.Random(6)
    al = ["a", "b.", "é", "😀", "@", "@x", ".", "..", "-", " ", "1", "255.", "300.", "4111", "1111", "+1", "(", ")", "+", "_", "x@y.z", "1.2.3.4", "4111111111111111", "+1 (988) 555-2485", "\n"]
    out = [(i, "".join(rng.choice(al) for _ in range(rng.randint(0, 40)))) for i in range(800)]
    out += [(1000, None), (1001, ""), (1002, "q@w.er_d@e.f a@b.c@d.e"), (1003, "1.2.3.4.5.6.7.8.9"), (1004, "1 " * 30000), (1005, "a@b.co " * 300 + "é 10.0.0.1"), (1005, "a@b.co"), (1006, "x" * 60000 + "@"), (1007, "9" * 50000)]
    return out


def test_base_spans(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as base", "2 as spans")
    got = sorted((r.doc_id, [tuple(x) for x in r.spans], [tuple(x) for x in r.base]) for r in pii.find_pii(df).collect())
    want = sorted((i, brute(t)) for i, t in data)
    assert [(i, sorted(b)) for i, _, b in got] == want
    for _, spans, base in got:
        assert set(base) <= set(spans)


def test_digest(spark, tmp_path):
    spark.createDataFrame(rows(), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    by = {r.doc_id: r for r in pii.op3_pii(spark, str(tmp_path)).collect() if r.doc_id != 1005}
    for i, t in rows():
        if i != 1005:
            b = brute(t)
            assert by[i].base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in b).encode()).hexdigest()
            assert (by[i].n_email, by[i].n_phone) == (sum(k == 0 for _, k, _ in b), sum(k == 3 for _, k, _ in b))


def test_no_python_on_the_way(spark, sf):
    plan = pii.op3_pii(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty(spark):
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.integers(0, 1), st.integers(0, 30)), min_size=1, max_size=30))
def test_boosting_lowers_the_loss(table):
    import math

    rows = sorted({(a, b, *[0] * 7): (n * y, n * (1 - y)) for a, b, y, n in table}.items())
    data = [(x, p, n) for x, (p, n) in rows]
    trees = pii._boost(data)
    loss = lambda s: sum(p * math.log1p(math.exp(-v)) + n * math.log1p(math.exp(v)) for (_, p, n), v in zip(data, s))
    assert loss([sum(pii._one(t, x) for t in trees) for x, *_ in data]) <= loss([0.0] * len(data)) + 1e-9


def test_threshold_keeps_precision():
    x, y = (2, 5, 0, 0, 1, 1, 0, 0, 0), (2, 1, 0, 0, 1, 1, 0, 0, 0)
    trees, limits = pii.fit([(x, h, 500, 0) for h in (0, 1)] + [(y, h, 0, 500) for h in (0, 1)])
    s = lambda v: sum(pii._one(t, v) for t in trees)
    assert s(x) >= limits[2] > s(y)
    assert pii.fit([]) == ([], {})


def brute_added(spans_base, tries, added_ok, score):
    """Additions by all pairs: what meets no base span and isn't beaten by an overlapping one."""
    free = [t for t in tries if added_ok(t) and not any(t[0] < e and s < t[2] for s, _, e in spans_base)]
    key = lambda t: (score(t), -t[0], t[1])
    return sorted((s, k, e) for s, k, e in free if not any(a < e and s < b and key((a, j, b)) > key((s, k, e)) for a, j, b in free if j != k))


def test_added_spans_against_all_pairs(spark, monkeypatch):
    """With a known score in place of the trees, additions are those that all pairs give."""
    from pyspark.sql import functions as F

    rng = random.Random(5)
    al = ["1.2[.]3.4", "10 . 0 . 0 . 1", "a(at)b.co", "a.b @ c.d", "988 555 2485", "4111.1111.1111.1111", "1.2.3.4", "x@y.zz", "+1 988 555 2485", " ", "-", "12 34 56", ". "]
    data = [(i, "".join(rng.choice(al) + rng.choice([" ", "", "; "]) for _ in range(rng.randint(1, 30)))) for i in range(150)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    monkeypatch.setattr(pii, "fit", lambda table: ([()], dict.fromkeys(range(4), 3.0)))
    monkeypatch.setattr(pii, "_score", lambda trees, c: F.col("x") if c is None else ((c["start"] * 7 + c["end"]) % 11).cast("double"))
    valid = {
        0: lambda m: re.search("[A-Za-z]{2}$", m) is not None,
        1: lambda m: max(map(int, re.sub("[^0-9.]", "", m).split("."))) <= 255 and len(re.sub("[^0-9.]", "", m).split(".")) == 4,
        2: lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m)),
        3: lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    n = 0
    for r in pii.find_pii(df).collect():
        t = dict(data)[r.doc_id]
        base = brute(t)
        import regex

        tries = [(m.start(), k, m.end()) for k, p in enumerate(pii.PROPOSE.values()) for m in regex.finditer(p, t, regex.A)]
        score = lambda x: (x[0] * 7 + x[2]) % 11
        want = brute_added(base, tries, lambda x: valid[x[1]](t[x[0] : x[2]]) and score(x) >= 3, score)
        assert sorted(map(tuple, r.spans)) == sorted([*base, *want])
        n += len(want)
    assert n > 100


def planted():
    """Base items, the same in unknown forms, and neutral numbers, each in its own document."""
    rng = random.Random(6)
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows, want = [], {}
    for i in range(3000):
        a, b = f"u{num(3)}", f"host{num(2)}"
        ip = ".".join(str(rng.randrange(256)) for _ in range(4))
        if i % 10 < 6:
            text = [f"please write to {a}@{b}.com today", f"the server {ip} is down", f"please call +1 988 555 {num(4)} now"][i % 3]
            rows.append((i, text))
        elif i % 10 < 8:
            item = [f"{a}(at){b}.com", ip.replace(".", "[.]"), f"1 988 555 {num(4)}"][i % 3]
            rows.append((i, ["please write to ", "the server ", "please call "][i % 3] + item + [" today", " is down", " now"][i % 3]))
            want[i] = item
        else:
            rows.append((i, f"part {num(3)}-{num(4)}-{num(4)} of lot {num(2)}.{num(2)}.{num(2)}"))
    return rows, want


def test_planted_forms_are_added_and_neutral_numbers_are_not(spark):
    rows, want = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    by = {r.doc_id: r for r in pii.find_pii(df).collect()}
    added = {i: [t[s.start : s.end] for s in by[i].spans if s not in by[i].base] for i, t in rows}
    hit = sum(want.get(i) in x for i, x in added.items() if i in want)
    all_added = sum(map(len, added.values()))
    assert hit >= 0.9 * len(want) and hit >= 0.9 * all_added
    for row in pii.calibration(df):
        assert row["found"] >= 0.9 * row["planted"] and row["false"] <= 0.1 * max(1, row["found"])


def test_time_is_near_linear_in_the_spans_of_a_text(spark):
    import time

    took = []
    for n in (2000, 16000):
        text = " ".join(f"10.0.{k % 256}.{k % 250} (988) 555-{k % 10000:04}" for k in range(n // 2))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        pii.find_pii(df).collect()
        began = time.perf_counter()
        r = pii.find_pii(df).first()
        took.append(time.perf_counter() - began)
        assert len(r.base) == n // 2
    assert took[1] < 30
