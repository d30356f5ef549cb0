"""SimHash near-duplicates, found by BK-trees over sharded fingerprints.

Distinct fingerprints are routed to shards: of four 16-bit blocks, two
fingerprints within 2 bits agree on at least two, so each fingerprint goes to
the six shards named by a pair of blocks and every link falls inside a shard.
A shard holds a BK-tree whose children are keyed by their integer Hamming
distance to the parent; a search follows only edges within the radius.

The trees travel by shuffle, not by broadcast: together they hold every
fingerprint of the corpus, so no size bound could be proven for a broadcast.
A shard of over HOT fingerprints is cut again by the 32 free bits in three
parts (one must agree), a part of over HOT by its 21 or 22 free bits likewise,
after which at most 2^15 different fingerprints can share a shard. Links emitted per shard are a spanning forest, never all pairs.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, fold, read
from .components import components

HOT = 4096
_PAIRS = list(combinations(range(4), 2))


class BKTree:
    """Burkhard-Keller tree over 64-bit integers under Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, x: int) -> None:
        new = len(self.values)
        self.values.append(x)
        self.children.append({})
        if not new:
            return
        at = 0
        while True:
            d = (self.values[at] ^ x).bit_count()
            nxt = self.children[at].get(d)
            if nxt is None:
                self.children[at][d] = new
                return
            at = nxt

    def within(self, x: int, radius: int) -> list[int]:
        """Positions of the values at `radius` or fewer differing bits."""
        out, stack = [], [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (self.values[at] ^ x).bit_count()
            if d <= radius:
                out.append(at)
            low, high = d - radius, d + radius
            for k, nxt in self.children[at].items():
                if low <= k <= high:
                    stack.append(nxt)
        return out


def simhash_words(words: list[bytes], width: int = 3) -> int:
    """64-bit SimHash of the word shingles (XXH64, seed 42); 0 for no words."""
    import numpy as np
    from xxhash import xxh64_intdigest

    if not words:
        return 0
    if len(words) < width:
        grams, n = iter((b" ".join(words),)), 1
    else:
        n = len(words) - width + 1
        grams = map(b" ".join, zip(*(words[i:] for i in range(width))))
    ones = np.zeros(64, np.int64)
    h = np.fromiter((xxh64_intdigest(g, 42) for g in grams), np.uint64, n)
    for i in range(0, n, 65536):
        bits = np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprint_batches(batches):
    import numpy as np
    import pyarrow as pa

    for b in batches:
        fps = np.empty(b.num_rows, np.uint64)
        for i, s in enumerate(b.column(1)):
            t = s.as_py()
            fps[i] = simhash_words(t.encode().lower().split()) if t else 0
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row per input row; null text counts as no words."""
    d = fold(docs, id_col, text_col)
    return d.mapInArrow(_fingerprint_batches, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, fp long")


def _block(i: int) -> Column:
    return F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF)


def _shards(fps: DataFrame) -> DataFrame:
    keys = []
    for p, (a, b) in enumerate(_PAIRS):
        c, d = (i for i in range(4) if i not in (a, b))
        rest = F.shiftleft(_block(c), 16).bitwiseOR(_block(d))
        keys.append(F.struct(F.shiftleft(F.lit(p).cast("long"), 32).bitwiseOR(F.shiftleft(_block(a), 16)).bitwiseOR(_block(b)).alias("shard"), rest.alias("rest")))
    return fps.select("fp", F.inline(F.array(*keys)))


def _tree_links(radius: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            us, vs = [], []
            for row in b.column(0):
                tree, root = BKTree(), []

                def find(i, root=root):
                    while root[i] != i:
                        root[i] = root[root[i]]
                        i = root[i]
                    return i

                for x in row.as_py():
                    u = x & 0xFFFFFFFFFFFFFFFF
                    near = tree.within(u, radius)
                    me = len(root)
                    root.append(me)
                    for j in near:
                        a, c = find(j), find(me)
                        if a != c:
                            root[c] = a
                            us.append(x)
                            y = tree.values[j]
                            vs.append(y - (1 << 64) if y >> 63 else y)
                    tree.add(u)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return run


def near_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(u, v) links that span every group of distinct fingerprints within `radius` (at most 2)."""
    if not 0 <= radius <= 2:
        raise ValueError("the four-block routing is exact up to radius 2")
    routed = _shards(fps.select("fp").distinct())
    n = routed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    routed = routed.join(n, "shard")
    whole = routed.where(F.col("n") <= HOT).groupBy("shard").agg(F.collect_list("fp").alias("fps")).select("fps")

    def cut(rest: Column, width: int, k: str, bits: str) -> Column:
        mask = (1 << width) - 1
        return F.inline(F.array(*(F.struct(F.lit(i).alias(k), F.shiftright(rest, width * i).bitwiseAND(mask if i < 2 else 2 * mask + 1).alias(bits)) for i in range(3))))

    one = ["shard", "k", "bits"]
    parts = routed.where(F.col("n") > HOT).select("shard", "fp", "rest", cut(F.col("rest"), 11, "k", "bits"))
    parts = parts.join(parts.groupBy(*one).agg(F.count(F.lit(1)).alias("m")).where("m > 1"), one)
    high = [F.shiftright("rest", s).bitwiseAND((1 << 32 - s) - 1) for s in (11, 22)]
    free = F.when(F.col("k") == 0, high[0]).when(F.col("k") == 1, F.shiftleft(high[1], 11).bitwiseOR(F.col("rest").bitwiseAND(0x7FF))).otherwise(F.col("rest").bitwiseAND(0x3FFFFF))
    deep = parts.where(F.col("m") > HOT).select(*one, "fp", cut(free, 7, "l", "more"))
    gather = F.collect_list("fp").alias("fps")
    cuts = [parts.where(F.col("m") <= HOT).groupBy(*one).agg(gather).select("fps"), deep.groupBy(*one, "l", "more").agg(gather).where(F.size("fps") > 1).select("fps")]
    return whole.unionAll(cuts[0]).unionAll(cuts[1]).mapInArrow(_tree_links(radius), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Null and blank texts have fingerprint zero and are linked like any other;
    repeated rows and exact copies share a fingerprint and thus a component; an
    empty table gives an empty result; other columns are ignored."""
    fp = durable(fingerprints(docs, id_col, text_col))
    roots = components(near_links(fp, radius))
    least = fp.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = least.join(roots, least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = durable(rooted.join(ids, "root").select("fp", "component_id"))
    return fp.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document of smallest id of every near-duplicate group, all columns kept.

    Rows that repeat an id count as one document and leave one row; a row of
    null id cannot be named by a group and goes. Empty in, empty out."""
    found = durable(near_duplicates(docs, id_col, text_col))
    keep = found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("__simhash_keep")).agg(F.count(F.lit(1)).alias("__n"))
    repeats = not keep.where("__n > 1").isEmpty()
    kept = docs.join(keep.select("__simhash_keep"), docs[id_col] == F.col("__simhash_keep"), "left_semi")
    return kept.dropDuplicates([id_col]) if repeats else kept


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
