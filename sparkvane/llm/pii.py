"""Personal data by candidate gradient boosting, in DataFrame functions only.

Four base patterns always count. High-recall generators propose further,
overlapping spans (obfuscated addresses, numbers without a prefix or with odd
separators). Each proposal has format and context features of few values; the
counts per feature vector and label form a table of bounded size, on which
boosted trees of depth two are fitted on the driver. Trees and thresholds
become one column expression, so scoring stays in the JVM.

Labels don't come from the base patterns' view of a proposal: positives are
valid base spans rewritten, in their own context, into forms that the base
patterns don't know (`(at)` for `@`, `[.]` for `.`, no `+`, other separators).
Negatives are proposals that meet no base span and are not valid for their
kind, or stand where no word in front speaks of the kind; what is valid and so
announced has no label. Per kind, the least score whose precision on held-out
documents, over rewritten spans and valid negatives, reaches PRECISION (lower
bound) is the threshold; only valid proposals are added.

Match positions come from the gaps between matches: `split` and
`regexp_extract_all` walk the same matches, and starts are prefix sums of
lengths (in blocks of 64). Spans of a kind are in order and apart, so overlaps
are found by binary search: the work grows with the spans of a text times
their logarithm.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, fold, id_crc, read

KINDS = ("email", "ip", "card", "phone")
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# Equal to the plain patterns: a run that fails from its start fails from inside, unless
# the last match ended inside it (\G); possessive repeats never give back in vain.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PROPOSE = {
    "email": r"(?<![\w.%+-])[\w.%+-]{1,64}+\x20?(?:@|\(at\)|\[at\])\x20?[\w-]{1,63}(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[\w-]{2,24}){1,4}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:(?:\.|\[\.\]|\x20\.\x20)[0-9]{1,3}){3}(?![0-9.])",
    "card": r"(?<![0-9])[0-9](?:[\x20._/-]?[0-9]){11,18}(?![0-9])",
    "phone": r"(?<![0-9])(?:\+|00)?\(?[0-9]{1,4}\)?(?:[\x20./-]\(?[0-9]{2,4}\)?){2,4}(?![0-9])",
}
WORDS = {
    "email": r"(?i)(mail|contact|write|courriel|correo)",
    "ip": r"(?i)(\bip|address|host|server)",
    "card": r"(?i)(card|visa|credit|karte|carte|tarjeta)",
    "phone": r"(?i)(phone|tel|call|fax|mobil)",
}
HINT = r"[0-9@]|\(at\)|\[at\]"
PRECISION = 0.95
ROUNDS, RATE = 20, 0.4
FEATURES = ("digits", "seps", "sep_kinds", "before", "after", "word", "head", "masked")


def _char_class(c: Column) -> Column:
    return F.when(c == "", 0).when(c.rlike(r"^\s"), 1).when(c.rlike(r"^[\w]"), 2).otherwise(3)


def _features(kind: str, m: Column, left: Column, right: Column) -> list[Column]:
    digits = F.char_length(F.regexp_replace(m, "[^0-9]", ""))
    seps = F.regexp_replace(m, r"[\w]", "")
    kinds = reduce(lambda a, b: a + b, [F.contains(seps, F.lit(s)).cast("int") for s in (" ", ".", "-", "(")])
    f = [
        F.least(F.lit(7), (digits / 3).cast("int")),
        F.least(F.lit(3), (F.char_length(seps) / 2).cast("int")),
        F.least(F.lit(2), kinds),
        _char_class(F.right(left, F.lit(1))),
        _char_class(right),
        left.rlike(WORDS[kind]).cast("int"),
        F.when(m.startswith("+"), 1).when(m.startswith("("), 2).when(m.rlike("^[A-Za-z]"), 3).otherwise(0),
        m.rlike(r"\(at\)|\[at\]|\(dot\)|\[|\x20\.\x20").cast("int"),
    ]
    return [c.cast("int").alias(n) for c, n in zip(f, FEATURES)]


#: rewritten forms of a base span
REWRITE = {
    "email": (lambda m: F.regexp_replace(m, "@", "(at)"), lambda m: F.regexp_replace(F.regexp_replace(m, "@", " @ "), r"\.(?=[A-Za-z]+$)", "(dot)"), lambda m: F.regexp_replace(m, "@", "[at]")),
    "ip": (lambda m: F.regexp_replace(m, r"\.", "[.]"), lambda m: F.regexp_replace(m, r"\.", " . ")),
    "card": tuple(lambda m, s=s: F.regexp_replace(F.regexp_replace(m, "[^0-9]", ""), r"([0-9]{4})(?=[0-9])", f"$1{s}") for s in "._/"),
    "phone": (lambda m: F.substring(m, 2, 1 << 30), lambda m: F.concat(F.lit("00"), F.substring(m, 2, 1 << 30)), lambda m: F.regexp_replace(F.substring(m, 2, 1 << 30), "[^0-9]+", ".")),
}


def _valid_proposal(kind: str, m: Column) -> Column:
    if kind == "email":
        return m.rlike("[A-Za-z]{2}$")
    return _valid(kind, F.regexp_replace(m, r"[^0-9.]", "") if kind == "ip" else m)


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.char_length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.char_length(digits).between(9, 15)
    return F.lit(True)


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)


def with_starts(df: DataFrame, names: list[str]) -> DataFrame:
    """Adds s_<name>, the running sums of match and gap lengths, in blocks of 64.

    Each step is a column of its own that the next one reads at least twice, so
    that the optimizer never folds it into a lambda to be worked out per element."""

    def step(n: str) -> Column:
        lens = F.concat(F.array(F.lit(0)), F.transform(F.col(f"m_{n}"), lambda x: F.char_length(x)))
        return F.zip_with(F.col(f"g_{n}"), lens, lambda a, b: a + b)

    def sums(n: str) -> Column:
        x = F.col(f"step_{n}")
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / 64).cast("int")), lambda b: _total(F.slice(x, b * 64 + 1, F.lit(64))))

    def before(n: str) -> Column:
        x = F.col(f"sums_{n}")
        return F.transform(F.sequence(F.lit(0), F.size(x) - 1), lambda b: F.when(b > 0, _total(F.slice(x, F.lit(1), b))).otherwise(F.lit(0).cast("long")))

    def starts(n: str) -> Column:
        x, pre = F.col(f"step_{n}"), F.col(f"before_{n}")
        inner = lambda b: F.transform(F.sequence(F.lit(1), F.least(F.lit(64), F.size(x) - b * 64)), lambda k: F.element_at(pre, b + 1) + _total(F.slice(x, b * 64 + 1, k)))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(pre) - 1), inner))

    for prefix, f in (("step", step), ("sums", sums), ("before", before), ("s", starts)):
        df = df.withColumns({f"{prefix}_{n}": F.when(F.col(f"m_{n}").isNotNull(), f(n)) for n in names})
    return df.drop(*(f"{x}_{n}" for x in ("step", "sums", "before") for n in names))


def _scan(docs: DataFrame, patterns: dict[str, dict[str, str]], hint: str, context: tuple[str, ...] = ()) -> DataFrame:
    """Per row and pattern: the matches, and the steps whose prefix sums are their starts."""
    some = docs.withColumn("hit", F.col("text").rlike(hint))
    cols: list[Column] = []
    for group, by_kind in patterns.items():
        for kind, p in by_kind.items():
            gaps = F.when(F.col("hit"), F.split("text", p, -1))
            cols.append(F.when(F.col("hit"), F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias(f"m_{group}_{kind}"))
            cols.append(F.transform(gaps, lambda g: F.char_length(g)).alias(f"g_{group}_{kind}"))
            if group in context:
                cols.append(F.transform(gaps, lambda g: F.right(g, F.lit(24))).alias(f"l_{group}_{kind}"))
                cols.append(F.transform(gaps, lambda g: F.substring(g, 1, 1)).alias(f"r_{group}_{kind}"))
    return durable(some.select("doc_id", *cols))


def _spans(group: str, kind: str, order: int, valid) -> Column:
    """array<struct<start, k, end>> of the matches that pass."""
    m = F.col(f"m_{group}_{kind}")
    both = F.zip_with(m, F.slice(F.col(f"s_{group}_{kind}"), F.lit(1), F.size(m)), lambda x, s: F.struct(x.alias("m"), s.alias("s")))
    ok = F.filter(both, lambda x: valid(kind, x["m"]))
    return F.transform(ok, lambda x: F.struct(x["s"].alias("start"), F.lit(order).alias("k"), (x["s"] + F.char_length(x["m"])).alias("end")))


def span_text(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["start"], x["end"])), ",")


def _boost(rows: list[tuple[tuple[int, ...], int, int]]) -> list[tuple]:
    """Boosted depth-two trees on (vector, positives, negatives); a tree is
    (feature, cut, (feature, cut, low, high), (feature, cut, low, high))."""
    trees: list[tuple] = []
    score = [0.0] * len(rows)

    def split(idx, grad, hess):
        best = None
        total_g, total_h = sum(grad[i] for i in idx), sum(hess[i] for i in idx)
        for f in range(len(rows[0][0])):
            acc: dict[int, list[float]] = {}
            for i in idx:
                a = acc.setdefault(rows[i][0][f], [0.0, 0.0])
                a[0] += grad[i]
                a[1] += hess[i]
            g = h = 0.0
            for v in sorted(acc)[:-1]:
                g, h = g + acc[v][0], h + acc[v][1]
                gain = g * g / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1)
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, f, v)
        return best

    def leaf(idx, grad, hess):
        return RATE * sum(grad[i] for i in idx) / (sum(hess[i] for i in idx) + 1)

    for _ in range(ROUNDS):
        grad, hess = [], []
        for (_, pos, neg), s in zip(rows, score):
            p = 1 / (1 + math.exp(-s))
            grad.append(pos * (1 - p) - neg * p)
            hess.append((pos + neg) * p * (1 - p))
        every = list(range(len(rows)))
        top = split(every, grad, hess)
        if top is None:
            break
        _, f, v = top
        sides = []
        for part in ([i for i in every if rows[i][0][f] <= v], [i for i in every if rows[i][0][f] > v]):
            s = split(part, grad, hess)
            f2, v2 = (s[1], s[2]) if s else (0, 1 << 30)
            low, high = [i for i in part if rows[i][0][f2] <= v2], [i for i in part if rows[i][0][f2] > v2]
            sides.append((f2, v2, leaf(low, grad, hess), leaf(high, grad, hess)))
        tree = (f, v, *sides)
        trees.append(tree)
        score = [s + _one(tree, r[0]) for s, r in zip(score, rows)]
    return trees


def _one(tree: tuple, x: tuple[int, ...]) -> float:
    f2, v2, low, high = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return low if x[f2] <= v2 else high


def fit(table: list[tuple]) -> tuple[list[tuple], dict[int, float]]:
    """Trees, and per kind the least score with held-out precision of PRECISION
    (Wilson lower bound). table: (vector with the kind first, fold, positives, negatives)."""
    by: dict[tuple[int, tuple], list[int]] = {}
    for x, held, pos, neg in table:
        c = by.setdefault((held, x), [0, 0])
        c[0] += pos
        c[1] += neg
    train = sorted((x, p, n) for (h, x), (p, n) in by.items() if not h)
    if not train:
        return [], {}
    trees = _boost(train)
    limits: dict[int, float] = {}
    for kind in range(len(KINDS)):
        scored = sorted(((sum(_one(t, x) for t in trees), p, n) for (h, x), (p, n) in by.items() if h and x[0] == kind), reverse=True)
        pos = neg = 0
        for k, (s, p, n) in enumerate(scored):
            pos, neg = pos + p, neg + n
            if k + 1 < len(scored) and scored[k + 1][0] == s:
                continue
            total, z = pos + neg, 1.645
            if total:
                r = pos / total
                low = (r + z * z / (2 * total) - z * math.sqrt(r * (1 - r) / total + z * z / (4 * total * total))) / (1 + z * z / total)
                if low >= PRECISION:
                    limits[kind] = s
    return trees, limits


def _score(trees: list[tuple], c: Column) -> Column:
    names = ("k", *FEATURES)

    def side(s):
        return F.when(c[names[s[0]]] <= s[1], F.lit(float(s[2]))).otherwise(F.lit(float(s[3])))

    parts = [F.when(c[names[t[0]]] <= t[1], side(t[2])).otherwise(side(t[3])) for t in trees]
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def _vector(i: int, kind: str, m: Column, x: Column) -> list[Column]:
    return [F.lit(i).alias("k"), *_features(kind, m, x["l"], x["r"]), F.coalesce(_valid_proposal(kind, m), F.lit(False)).alias("ok")]


def _proposal(i: int, kind: str):
    def made(x: Column) -> Column:
        end = x["s"] + F.char_length(x["m"])
        return F.struct(x["s"].cast("long").alias("start"), end.cast("long").alias("end"), *_vector(i, kind, x["m"], x))

    return made


def _rewritten(i: int, kind: str):
    """A base match as the proposal it would be in another form; null if it would be none."""

    def made(x: Column) -> Column:
        forms = F.array(*(f(x["m"]) for f in REWRITE[kind]))
        m = F.element_at(forms, (F.crc32(x["m"].cast("binary")) % len(REWRITE[kind]) + 1).cast("int"))
        return F.when(F.regexp_extract(m, PROPOSE[kind], 0) == m, F.struct(*_vector(i, kind, m, x)))

    return made


_POWERS = [1 << k for k in range(27, -1, -1)]


def _count_below(spans: Column, below) -> Column:
    """Of spans in order, the number for which below(span) holds; it must hold for a prefix."""
    return F.aggregate(F.array(*map(F.lit, _POWERS)), F.lit(0), lambda n, p: F.when(below(F.get(spans, n + p - 1)), n + p).otherwise(n))


def _touches(spans: Column, x: Column) -> Column:
    """Does one of `spans` (in order, apart) overlap x?"""
    return F.coalesce(F.get(spans, _count_below(spans, lambda y: y["start"] < x["end"]) - 1)["end"] > x["start"], F.lit(False))


def _overlapping(spans: Column, x: Column) -> Column:
    """Those of `spans` (in order, apart) that overlap x."""
    first = _count_below(spans, lambda y: y["end"] <= x["start"])
    return F.slice(spans, first + 1, _count_below(spans, lambda y: y["start"] < x["end"]) - first)


def of_kind(spans: str, i: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["k"] == i)).cast("long")


_TABLE = ["k", *FEATURES]


def _candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, base_<kind>, tries_<kind> (`any`: does it meet a base span), plants_<kind>."""
    rows = _scan(fold(docs, id_col, text_col), {"base": BASE, "try": PROPOSE}, HINT, ("base", "try"))
    rows = with_starts(rows, [f"{g}_{k}" for g in ("base", "try") for k in KINDS])
    vector = ",".join(f"{n}:int" for n in _TABLE) + ",ok:boolean"

    def zipped(group: str, k: str) -> Column:
        m, s, left, right = (F.col(f"{c}_{group}_{k}") for c in "mslr")
        n = F.size(m)
        z = F.arrays_zip(m.alias("m"), F.slice(s, F.lit(1), n).alias("s"), F.slice(left, F.lit(1), n).alias("l"), F.slice(right, F.lit(2), n).alias("r"))
        return F.when(n > 0, z)

    cols = []
    for i, k in enumerate(KINDS):
        base, tries = zipped("base", k), zipped("try", k)
        none = lambda kind: F.array().cast(f"array<struct<{kind}>>")
        cols.append(F.coalesce(_spans("base", k, i, _valid), none("start:bigint,k:int,end:bigint")).alias(f"base_{k}"))
        cols.append(F.coalesce(F.transform(tries, _proposal(i, k)), none("start:bigint,end:bigint," + vector)).alias(f"tries_{k}"))
        plants = F.filter(F.transform(F.filter(base, lambda x: _valid(k, x["m"])), _rewritten(i, k)), lambda x: x.isNotNull())
        cols.append(F.coalesce(plants, none(vector)).alias(f"plants_{k}"))
    found = durable(rows.select("doc_id", *cols))
    meets = lambda x: reduce(lambda a, b: a | b, (_touches(F.col(f"base_{k}"), x) for k in KINDS))
    flagged = [F.transform(f"tries_{k}", lambda x: F.struct(x.alias("c"), meets(x).alias("any"))).alias(f"tries_{k}") for k in KINDS]
    return durable(found.select("doc_id", *(f"base_{k}" for k in KINDS), *flagged, *(f"plants_{k}" for k in KINDS)))


def _table(found: DataFrame) -> list[tuple]:
    """(vector, held out, positives, negatives); held-out negatives are valid ones only."""
    held = F.coalesce(id_crc("doc_id") % 2 == 0, F.lit(False)).alias("held")
    planted = found.select(held, F.explode(F.concat(*(F.col(f"plants_{k}") for k in KINDS))).alias("c")).where("c.ok")
    free = found.select(held, F.explode(F.concat(*(F.col(f"tries_{k}") for k in KINDS))).alias("t")).where("not t.any").select("held", "t.c")
    not_so = free.where("(not c.ok and not held) or (c.ok and c.word = 0)")
    both = planted.withColumn("y", F.lit(1)).select("held", "y", "c").unionByName(not_so.withColumn("y", F.lit(0)).select("held", "y", F.struct(*(F.col(f"c.{n}").alias(n) for n in (*_TABLE, "ok"))).alias("c")))
    by = both.groupBy(*(F.col(f"c.{n}").alias(n) for n in _TABLE), "held").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n"))
    return [(tuple(r[:9]), bool(r.held), r.p, r.n - r.p) for r in by.collect()]  # vectors have few values: under 200,000 rows at any size


def calibration(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Per kind, of the held-out documents: rewritten spans (planted), those of them that
    would be added (found), valid negatives (decoys), those of them that would be added (false)."""
    table = _table(_candidates(docs, id_col, text_col))
    trees, limits = fit(table)
    out = [{"kind": k, "planted": 0, "found": 0, "decoys": 0, "false": 0} for k in KINDS]
    for x, held, pos, neg in table:
        if held:
            row = out[x[0]]
            added = x[0] in limits and sum(_one(t, x) for t in trees) >= limits[x[0]] - 1e-9
            row["planted"] += pos
            row["decoys"] += neg
            row["found"] += pos * added
            row["false"] += neg * added
    return out


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans: array<struct<start, k (position in KINDS), end>>.

    A null text counts as empty and has no spans; equal rows get equal spans
    each; an empty table gives an empty result; other columns are ignored. Of
    overlapping additions that of the best score stays (then the first, then the
    later kind). Runs all jobs but the last while it is planned."""
    found = _candidates(docs, id_col, text_col)
    trees, limits = fit(_table(found))
    base = F.concat(*(F.col(f"base_{k}") for k in KINDS))
    if not limits:
        return found.select("doc_id", base.alias("base"), base.alias("spans"))

    def chosen(i: int, k: str) -> Column:
        ok = F.filter(f"tries_{k}", lambda t: ~t["any"] & t["c"]["ok"])
        scored = F.transform(ok, lambda t: F.struct(_score(trees, t["c"]).alias("score"), t["c"]["start"].alias("start"), F.lit(i).alias("k"), t["c"]["end"].alias("end")))
        return F.filter(scored, lambda x: x["score"] >= F.lit(float(limits[i]) - 1e-9)).alias(f"kept_{k}")

    some = [(i, k) for i, k in enumerate(KINDS) if i in limits]
    kept = durable(found.select("doc_id", base.alias("base"), *(chosen(i, k) for i, k in some)))
    rank = lambda x: F.struct(x["score"], -x["start"], x["k"])
    extra = []
    for _, k in some:
        beaten = lambda x: reduce(lambda a, b: a | b, (F.exists(_overlapping(F.col(f"kept_{o}"), x), lambda y: rank(y) > rank(x)) for _, o in some if o != k), F.lit(False))
        best = F.filter(f"kept_{k}", lambda x: ~beaten(x))
        extra.append(F.transform(best, lambda x: F.struct(x["start"].alias("start"), x["k"].alias("k"), x["end"].alias("end"))))
    return kept.select("doc_id", "base", F.concat("base", *extra).alias("spans"))


def op3_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(read(spark, sf_dir, "documents"))
    counts = [of_kind("base", i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(span_text(F.col("base"), KINDS), 256).alias("base_sha256"), span_text(F.col("spans"), KINDS).alias("spans"))
