"""Secret scans over an incremental blob ledger.

A text is a blob named by the SHA-256 of its bytes; ids are the paths under
which its versions appear. The ledger is a Parquet table (blob, rule, spans)
in a folder that outlives a run. A scan lists the (blob, rule version) pairs
that the ledger lacks, reads one text for each unseen blob, appends what it
finds (blobs without findings too) and joins the ledger back to all paths. Up
to FEW unseen blobs are sought by a broadcast of 64-bit hashes (a false match costs
a scan, no more), so that no text moves; of more, the texts are shuffled to the names.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import durable, fold, read, shared_dir, slices

FEW, SPANS = 1 << 21, 1 << 19  # unseen blobs, and spans of findings, that are broadcast

KINDS = ("assign", "access", "hex", "pem", "github", "slack", "stripe")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # a shorter run fails from its inside, too
_HEX = re.compile(r"[0-9a-f]{16,}")
_EXTRA = {
    "pem": re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}-----END [A-Z ]{0,40}PRIVATE KEY-----"),
    "github": re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"),
    "slack": re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{20,}\b"),
    "stripe": re.compile(r"\b[sr]k_live_[A-Za-z0-9]{20,}\b"),
}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three base kinds."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return out


def provider_spans(text: str) -> list[tuple[int, int, int]]:
    """Keys with a form of their own."""
    return [(m.start(), KINDS.index(k), m.end()) for k, p in _EXTRA.items() for m in p.finditer(text)]


#: rule and version -> finder; a changed finder needs a new version
RULES = {"base:1": base_spans, "provider:1": provider_spans}
_LEDGER = "blob string, rule string, spans array<struct<start:bigint,k:int,end:bigint>>"


def _scan(rules):
    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("k", pa.int32()), ("end", pa.int64())]))
        seen: set[str] = set()  # a row may be repeated
        for batch in batches:
            for b in slices(batch):
                blobs, names, spans = [], [], []
                for blob, todo, text in zip(*(b.column(c).to_pylist() for c in ("own", "todo", "text"))):
                    if blob in seen:
                        continue
                    seen.add(blob)
                    for r in (r for i, r in enumerate(rules) if todo >> i & 1):
                        blobs.append(blob)
                        names.append(r)
                        spans.append([{"start": s, "k": k, "end": e} for s, k, e in sorted(rules[r](text))])
                yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.string()), pa.array(names, pa.string()), pa.array(spans, kind)], ["blob", "rule", "spans"])

    return run


def _once(batches):
    """Each blob of a partition once, so that no row repeated without bound is shuffled."""
    import pyarrow as pa

    seen: set[str] = set()
    for b in batches:
        new = []
        for blob in b.column(b.schema.get_field_index("own")).to_pylist():
            new.append(blob not in seen)
            seen.add(blob)
        yield b.filter(pa.array(new, pa.bool_()))


def _ledger(spark, path: str) -> DataFrame:
    try:
        return spark.read.schema(_LEDGER).parquet(path)
    except AnalysisException:  # no scan has written it yet
        return spark.createDataFrame([], _LEDGER)


def _blob(text):
    return F.sha2(text.cast("binary"), 256)


def update_ledger(docs: DataFrame, ledger: str, rules, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Scan what the ledger lacks; (paths: doc_id, blob), (blob, spans) for blobs with findings."""
    spark = docs.sparkSession
    d = fold(docs, id_col, text_col)
    paths = durable(d.select("doc_id", _blob(F.col("text")).alias("blob")))
    one = paths.groupBy("blob").agg(F.min("doc_id").alias("rep"))
    pairs = one.select("blob", "rep", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << i).alias("bit")) for i, r in enumerate(rules)))).alias("x")).select("blob", "rep", "x.*")
    unseen = durable(pairs.join(_ledger(spark, ledger), ["blob", "rule"], "left_anti").groupBy("blob", "rep").agg(F.bit_or("bit").alias("todo")))
    held = d.withColumn("own", _blob(F.col("text")))
    if unseen.count() <= FEW:
        names = unseen.groupBy(F.xxhash64("rep", "blob").alias("name")).agg(F.bit_or("todo").alias("todo"))
        due = held.join(F.broadcast(names), F.xxhash64("doc_id", "own") == F.col("name"))
    else:
        due = held.mapInArrow(_once, held.schema).join(unseen.select(F.col("blob").alias("own"), "todo"), "own")
    found = due.select("own", "todo", "text").mapInArrow(_scan(rules), _LEDGER)
    found.dropDuplicates(["blob", "rule"]).write.mode("append").parquet(ledger)
    seen = _ledger(spark, ledger).where(F.col("rule").isin(list(rules)) & (F.size("spans") > 0))
    by_blob = seen.dropDuplicates(["blob", "rule"]).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    return paths, by_blob


def find_secrets(docs: DataFrame, ledger: str, rules=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (array<struct<start, k (position in KINDS), end>>), one row per row of `docs`.

    A null text is the empty blob; equal texts are scanned once, whatever their
    ids (null ids too); repeated rows each get their findings; an empty table
    adds nothing to the ledger; other columns are ignored."""
    paths, by_blob = update_ledger(docs, ledger, RULES if rules is None else rules, id_col, text_col)
    none = F.array().cast("array<struct<start:bigint,k:int,end:bigint>>")
    return paths.join(by_blob, "blob", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def fresh_ledger(spark) -> str:
    return f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"


def mask_secrets(docs: DataFrame, ledger: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with each run of overlapping secrets replaced by [SECRET]; all rows and
    columns kept, n_chars (if there) counted anew; other texts, null too, stay as they are."""
    _, by_blob = update_ledger(docs, ledger, RULES, id_col, text_col)
    by_blob = durable(by_blob)
    if (by_blob.agg(F.sum(F.size("spans"))).first()[0] or 0) <= SPANS:  # else the texts are shuffled
        by_blob = F.broadcast(by_blob)
    names = docs.columns
    text = F.col(f"c{names.index(text_col)}").cast("string")
    held = docs.toDF(*(f"c{i}" for i in range(len(names)))).withColumn("own", _blob(text))  # no name clashes then
    hit = held.join(by_blob, held.own == by_blob.blob, "left").withColumn("cut", _masked(text, F.col("spans")))
    cols = []
    for i, c in enumerate(names):
        old = F.col("cut" if c == text_col else f"c{i}")
        if c == "n_chars":
            old = F.when(F.col("spans").isNotNull(), F.char_length("cut")).otherwise(old).cast(docs.schema[i].dataType)
        cols.append(old.alias(c))
    return hit.select(*cols)


def _masked(text, spans, mark: str = "[SECRET]"):
    """Column: `text` with `spans` (sorted by start) replaced."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("pos"))

    def step(acc, x):
        between = F.substring(text, (acc["pos"] + 1).cast("int"), (x["start"] - acc["pos"]).cast("int"))
        out = F.when(x["start"] >= acc["pos"], F.concat(acc["out"], between, F.lit(mark))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["pos"], x["end"]).alias("pos"))

    rest = lambda a: F.concat(a["out"], F.substring(text, (a["pos"] + 1).cast("int"), F.lit(1 << 30)))
    return F.when(spans.isNull(), text).otherwise(F.aggregate(spans, start, step, rest))


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    from .pii import of_kind, span_text

    found = durable(find_secrets(read(spark, sf_dir, "documents"), fresh_ledger(spark)))
    found = found.withColumn("base", F.filter("spans", lambda s: s["k"] < 3))
    counts = [of_kind("base", i).alias(f"n_{KINDS[i]}") for i in range(3)]
    return found.select("doc_id", *counts, F.sha2(span_text(F.col("base"), KINDS), 256).alias("base_sha256"), span_text(F.col("spans"), KINDS).alias("spans"))


def _sql_class(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_SQL_ASSIGN = "(" + "|".join(_sql_class(w) for w in ("password", "passwd", "secret", "token")) + "|" + _sql_class("api") + "_?" + _sql_class("key") + ")" + r"""["\'\']?\x20*[:=]\x20*["\'\']?([A-Za-z0-9+/_.=-]+)""".replace("\\'", "'")
_SQL_PATTERNS = [
    ("assign", _SQL_ASSIGN, f"length(regexp_extract(m[i], '{_SQL_ASSIGN}', 2)) >= 12"), ("access", "AKIA[A-Z0-9]{14,}", "true"), ("hex", "[0-9a-f]{16,}", "true"),
    ("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}-----END [A-Z ]{0,40}PRIVATE KEY-----", "true"),
    ("github", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b", "true"), ("slack", r"\bxox[abprs]-[A-Za-z0-9-]{20,}\b", "true"), ("stripe", r"\b[sr]k_live_[A-Za-z0-9]{20,}\b", "true"),
]


def _sql_spans(k: int, name: str, pattern: str, ok: str) -> str:
    return f"""select doc_id, {k} as k, '{name}' as kind, s, s + length(m[i]) as e from (
      select doc_id, m, i, list_sum(list_transform(list_slice(g, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(m, 1, i - 1), lambda x: length(x))), 0) as s from (
        select doc_id, regexp_extract_all(t, '{pattern}') as m, string_split_regex(t, '{pattern}') as g, unnest(range(1, len(regexp_extract_all(t, '{pattern}')) + 1)) as i from docs)) where {ok}"""


OP10_SQL = f"""
with docs as (select doc_id, coalesce(text, '') as t from documents),
f as ({" union all ".join(_sql_spans(k, *x) for k, x in enumerate(_SQL_PATTERNS))}),
a as (select doc_id, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex,
  string_agg(kind || ':' || s::bigint || ':' || e::bigint, ',' order by s, k) filter (k < 3) as base, string_agg(kind || ':' || s::bigint || ':' || e::bigint, ',' order by s, k) as spans from f group by 1)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join a using (doc_id)
"""
