"""Benchmark decontamination with an FM-index per training shard.

The benchmark is the stated query set: its windows, in blocks of BLOCK windows
(long items are cut, with the overlap that windows need), are compiled and
broadcast one block at a time. Every shard of whole documents (SHARD_BYTES) becomes an
FM-index over the words of the block's vocabulary; a run of fewer such words
than the shortest window cannot hold one and is left out, which loses nothing.
All windows are searched backwards at once, located by sampled suffix
positions, and their spans merged. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from itertools import repeat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import durable, fold, read, slices

WINDOW = 10
BLOCK = 1 << 19  # windows
SHARD_BYTES = 4 << 20
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # of texts as they are
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_STATE = [StructField("__n_words", LongType()), StructField("__starts", ArrayType(LongType())), StructField("__ends", ArrayType(LongType())), StructField("__items", ArrayType(StringType()))]


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words as UTF-8."""
    return text.encode().translate(_TABLE).split() if text else []


def blocks(items, window: int = WINDOW, most: int = BLOCK):
    """Lists of (item, words) of at most `most` windows; an item of more is cut."""
    part, held = [], 0
    for ident, text in items:
        w = words_of(text)
        if not w:
            continue
        at = 0
        while True:
            take = min(most - held, max(1, len(w) - at - window + 1))
            part.append((ident, w[at : at + take + window - 1]))
            held, at = held + take, at + take
            if held == most:
                yield part
                part, held = [], 0
            if at + window - 1 >= len(w):
                break
    if part:
        yield part


def compile_windows(items, window: int = WINDOW) -> dict | None:
    """Distinct windows of (item, words) as symbol rows, right-aligned; window r is of the
    items names[i], i in who[of[r]:of[r + 1]]."""
    import numpy as np

    vocab: dict[bytes, int] = {}
    number: dict[str, int] = {}
    rows, owner = [], []
    for ident, words in items:
        w = np.array([vocab.setdefault(x, len(vocab) + 1) for x in words], np.int32)
        if len(w) < window:
            w = np.concatenate((np.zeros(window - len(w), np.int32), w))
        rows.append(np.lib.stride_tricks.sliding_window_view(w, window))
        owner.append(np.full(len(rows[-1]), number.setdefault("" if ident is None else str(ident), len(number)), np.int64))
    if not rows:
        return None
    pats, back = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
    pairs = np.unique(back.reshape(-1) * len(number) + np.concatenate(owner))
    of = np.searchsorted(pairs, np.arange(len(pats) + 1) * len(number))
    return {"vocab": vocab, "patterns": pats.astype(np.int64), "lengths": (pats > 0).sum(axis=1), "names": list(number), "of": of, "who": (pairs % len(number)).astype(np.int32)}


def search_shard(texts: list[str | None], q: dict):
    """Per text: number of words, merged hit spans in words [(start, end)], items."""
    import numpy as np

    from .fmindex import FMIndex

    get = q["vocab"].get
    ids, counts = [], []
    for t in texts:
        w = words_of(t)
        counts.append(len(w))
        ids.append(np.fromiter(map(get, w, repeat(0)), np.int32, len(w)))
    first = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    total = int(first[-1])
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    known = flat > 0
    if known.any():
        begins = known.copy()
        begins[1:] &= ~known[:-1]
        begins[first[:-1][np.asarray(counts) > 0]] |= known[first[:-1][np.asarray(counts) > 0]]
        run = np.cumsum(begins) - 1
        size = np.bincount(run[known], minlength=int(begins.sum()))
        keep = known & (size[run] >= int(q["lengths"].min()))
        origin = np.flatnonzero(keep)
        if len(origin):
            place = np.arange(len(origin)) + np.concatenate(([0], np.cumsum(np.diff(run[origin]) != 0)))
            text = np.zeros(int(place[-1]) + 2, np.int64)
            text[place] = flat[origin]
            back = np.zeros(len(text), np.int64)
            back[place] = origin
            index = FMIndex(text, len(q["vocab"]) + 1)
            rows, lo, hi = index.search(q["patterns"], q["lengths"])
            if len(rows):
                n = hi - lo
                which = np.repeat(rows, n)
                suffix = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
                start = back[index.locate(suffix)]
                doc = np.searchsorted(first, start, side="right") - 1
                edge = np.zeros(total + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + q["lengths"][which], -1)
                hit = np.cumsum(edge[:-1]) > 0
                change = hit.copy()
                change[1:] ^= hit[:-1]
                change[first[:-1][np.asarray(counts) > 0]] = hit[first[:-1][np.asarray(counts) > 0]]
                for s in np.flatnonzero(change & hit):
                    d = int(np.searchsorted(first, s, side="right") - 1)
                    off = np.flatnonzero(~hit[s : first[d + 1]])
                    e = int(s + off[0]) if len(off) else int(first[d + 1])
                    spans[d].append((int(s - first[d]), e - int(first[d])))
                for d, r in set(zip(doc.tolist(), which.tolist())):
                    items[d].update(q["names"][i] for i in q["who"][q["of"][r] : q["of"][r + 1]])
    return list(zip(counts, spans, items))


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans, sorted, touching ones joined."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _search(bc, last: str):
    """Adds or extends the state columns; `last`: what becomes of __text ("keep", "drop" or "cut")."""

    def run(batches):
        import pyarrow as pa

        q = bc.value
        for batch in batches:
            for b in slices(batch, SHARD_BYTES, "__text"):
                texts = b.column("__text").to_pylist()
                found = search_shard(texts, q) if q else [(len(words_of(t)), [], set()) for t in texts]
                old = zip(*(b.column(c).to_pylist() for c in ("__starts", "__ends", "__items"))) if "__starts" in b.schema.names else repeat(([], [], []))
                starts, ends, items = [], [], []
                for (_, spans, its), (s0, e0, i0) in zip(found, old):
                    m = merge_spans(spans + list(zip(s0, e0)))
                    starts.append([s for s, _ in m])
                    ends.append([e for _, e in m])
                    items.append(sorted(its.union(i0)))
                cols = {n: b.column(n) for n in b.schema.names}
                if last == "cut":
                    cols["__text"] = pa.array([cut_words(t, list(zip(s, e))) if s else t for t, s, e in zip(texts, starts, ends)], pa.string())
                elif last == "drop":
                    del cols["__text"]
                cols |= {"__n_words": pa.array([n for n, *_ in found], pa.int64()), "__starts": pa.array(starts, pa.list_(pa.int64())), "__ends": pa.array(ends, pa.list_(pa.int64())), "__items": pa.array(items, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_pydict(cols)

    return run


def _annotate(df: DataFrame, benchmark: DataFrame, item_col: str, item_text: str, window: int, last: str) -> DataFrame:
    """`df` (no column of its own begins with two underscores but __text) with the state columns.
    Runs a job per block while it is planned; what a block but the last finds is written out."""
    bench = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text).cast("string").alias("t"))
    todo = blocks((tuple(r) for r in bench.toLocalIterator()), window)
    part = next(todo, [])
    while part is not None:
        following = next(todo, None)
        bc = df.sparkSession.sparkContext.broadcast(compile_windows(part, window))
        how = last if following is None else "keep"
        own = {f.name for f in _STATE} | ({"__text"} if how == "drop" else set())
        fields = [f for f in df.schema if f.name not in own]
        df = df.mapInArrow(_search(bc, how), StructType(fields + _STATE))
        if following is not None:
            df = durable(df)
            bc.destroy()
        part = following
    return df


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text="text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, starts/ends (merged hit spans, in words), items, one row per input row.

    Null texts have no words and no items hit them; an item without words is
    never hit; fewer words than `window` make one window; repeated items count
    once by id (a null id as ''); an empty benchmark hits nothing."""
    d = fold(docs, id_col, text_col, None).withColumnRenamed("text", "__text")
    d = _annotate(d, benchmark, item_col, item_text, window, "drop")
    return d.select("doc_id", *(F.col(f"__{c}").alias(c) for c in ("n_words", "starts", "ends", "items")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col="text", item_col="item_id", item_text="text", window: int = WINDOW) -> DataFrame:
    """`docs` with every hit span of words cut out of its text (with the blank that
    follows it); all rows and columns kept, n_chars (if there) counted anew.

    A document without hits keeps its text as it is, null included."""
    names = docs.columns
    at = names.index(text_col)
    inner = docs.toDF(*(f"c{i}" for i in range(len(names))))  # no name clashes then
    held = inner.withColumn("__text", F.col(f"c{at}").cast("string")).drop(f"c{at}")
    out = _annotate(held, benchmark, item_col, item_text, window, "cut")
    cols = []
    for i, c in enumerate(names):
        old = F.col("__text" if i == at else f"c{i}")
        if c == "n_chars":
            old = F.coalesce(F.when(F.size("__starts") > 0, F.char_length("__text")), old).cast(docs.schema[i].dataType)
        cols.append(old.alias(c))
    return out.select(*cols)


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """`text` without the words of `spans` (word positions, half-open)."""
    at = [m.span() for m in WORD.finditer(text)]
    out, pos = [], 0
    for s, e in spans:
        out.append(text[pos : at[s][0]])
        pos = at[e - 1][1]
        if pos < len(text) and text[pos] == " ":
            pos += 1
    return "".join(out) + text[pos:]


def _digest(batches):
    import pyarrow as pa

    for b in batches:
        s, e, it = (b.column(c).to_pylist() for c in ("starts", "ends", "items"))
        hits = [sum(y) - sum(x) for x, y in zip(s, e)]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("n_words"), pa.array(hits, pa.int64()), pa.array([len(x) for x in it], pa.int64()),
             pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in it]), pa.array([h > 0 for h in hits])],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(_digest, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


_LOW = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOW + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP2_SQL = f"""
with b as (select item_id, {_WORDS.format(t="coalesce(text, '')")} as w from benchmark),
bw as (select distinct item_id, least(len(w), {WINDOW}) as k, array_to_string(list_slice(w, i, i + {WINDOW} - 1), ' ') as win
  from (select item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) as i from b where len(w) > 0)),
ks as (select distinct k from bw),
d as (select doc_id, {_WORDS.format(t="coalesce(text, '')")} as w from documents),
dw as (select doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') as win
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, ks where len(w) >= k)),
o as (select dw.doc_id, dw.i, dw.k, bw.item_id from dw join bw on dw.k = bw.k and dw.win = bw.win),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from o) group by 1),
t as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items from o group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (doc_id) left join t using (doc_id)
"""
