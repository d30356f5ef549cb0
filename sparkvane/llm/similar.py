"""SimHash near-dedup at a stated similarity: BK-trees over shards, then an exact check.

Two texts are near copies if their sets of five-word shingles have a Jaccard
similarity of at least 0.8. A similarity of 0.8 is an angle whose SimHash bits
differ with a chance of 0.15 (0.19 for sets of four shingles, the worst), so
no small radius over 64 bits can find it: fingerprints have 256 bits here and
the radius is 72 (96 for sets of under 80 shingles), over five and seven
standard deviations away. Every candidate is checked on its shingles, so a
link is never wrong.

Shards are the buckets of a text's first shingles, in an order that puts those
that a sample shows to be in many texts last. With `cold` of n shingles not
hot, two similar sets have a union whose first K shingles are all unshared with
a chance of at most (n / 4 cold)^K; a text takes the K that makes this MISS, or
as many as must hold a shared one for certain, if these are fewer.

A shard holds a BK-tree, children keyed by their integer Hamming distance; only
edges within the radius are followed. First each text is linked to its nearest
neighbour in a shard; then texts of other roots than the shard's most frequent
one are searched for in all of it. A shard of over HOT texts is cut into blocks,
so no task holds one whole, and a group of m copies gives about m links.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, slices
from .components import components
from .lm import _mix, bigram_keys
from .simhash import BKTree

WIDTH = 5
NUM, DEN = 4, 5  # the least similarity, 0.8
BITS, RADIUS = 256, 72
SHORT, SHORT_RADIUS = 80, 96
MISS = 1e-12
HOT = 4096  # texts of a tree
FEW = 1 << 20  # ends of pairs that are broadcast
SAMPLE, SEEN, HOT_MOST = 64, 8, 1 << 16  # one text in SAMPLE; shingles in SEEN of these are hot; as many at most


def shingles(text: str):
    """Sorted distinct 64-bit hashes of the shingles; a shorter text is one, a blank one zero."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return np.zeros(1, np.uint64)
    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    width = min(WIDTH, len(h))
    n = len(h) - width + 1
    g = h[:n]
    for i in range(1, width):
        g = bigram_keys(g, h[i : i + n])
    return np.unique(g)


def fingerprint(g) -> bytes:
    """SimHash of a set of hashes: a bit is 1 if set in over half of them."""
    import numpy as np

    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(g), 16384):
        h = np.stack([_mix(g[i : i + 16384] + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) for k in range(BITS // 64)], 1)
        ones += np.unpackbits(h.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(g)).tobytes()


def reach(n: int, cold: int) -> int:
    """Shingles under which a set of n, `cold` of them not hot, is sharded."""
    sure = n - -(-NUM * n // DEN) + 1
    if (DEN - NUM) * n >= NUM * cold:
        return sure
    return min(sure, math.ceil(math.log(MISS) / math.log((DEN - NUM) * n / (NUM * cold))))


def _texts(f, schema):
    """Batches of f(node, shingles) -> row, each text of a partition once."""

    def run(batches):
        import pyarrow as pa

        seen: set[int] = set()
        for batch in batches:
            for b in slices(batch):
                rows = []
                for node, text in zip(b.column("node").to_pylist(), b.column("text").to_pylist()):
                    if node not in seen:
                        seen.add(node)
                        rows.append(f(node, shingles(text)))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)] if rows else [pa.array([], t) for t in schema.types], schema=schema)

    return run


def _features(hot):
    def f(node, g):
        import numpy as np

        n, cold, order = len(g), len(g), g
        if len(hot.value):
            at = np.minimum(np.searchsorted(hot.value, g), len(hot.value) - 1)
            is_hot = hot.value[at] == g
            cold -= int(is_hot.sum())
            order = np.concatenate((g[~is_hot], g[is_hot]))
        return node, n, order[: reach(n, cold)].view(np.int64), fingerprint(g)

    return f


def _fits(n: int, pos: int, m: int, at: int) -> bool:
    """May sets of n and m elements be similar whose shared element stands at these places?"""
    return (NUM + DEN) * (min(pos, at) + min(n - pos, m - at)) >= NUM * (n + m)


def _pairs(batches, links):
    import pyarrow as pa

    for b in batches:
        us, vs = [], []
        for row in b.column(0):
            for u, v in links(row.as_py()):
                us.append(min(u, v))
                vs.append(max(u, v))
            if len(us) > 1 << 18:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])
                us, vs = [], []
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])


def _radius(n: int) -> int:
    return SHORT_RADIUS if n < SHORT else RADIUS


def _nearest(batches):
    """Each text of a block with its nearest neighbour among those before it."""

    def links(block):
        tree = BKTree()
        for e in block:
            fp, n, pos = int.from_bytes(e["fp"], "little"), e["size"], e["pos"]
            best = None
            for j in tree.within(fp, _radius(n)):
                o = block[j]
                if _fits(n, pos, o["size"], o["pos"]):
                    d = ((tree.values[j] ^ fp).bit_count(), o["node"])
                    best = d if best is None or d < best else best
            tree.add(fp)
            if best:
                yield e["node"], best[1]

    return _pairs(batches, links)


def _across(batches):
    """Pairs of a block's searched texts and texts of another root."""

    def links(block):
        tree, held = BKTree(), []
        for e in block:
            if e["held"]:
                held.append(e)
                tree.add(int.from_bytes(e["fp"], "little"))
        for e in block:
            if e["sought"]:
                for j in tree.within(int.from_bytes(e["fp"], "little"), _radius(e["size"])):
                    o = held[j]
                    if o["root"] != e["root"] and (o["major"] or o["node"] < e["node"]) and _fits(e["size"], e["pos"], o["size"], o["pos"]):
                        yield e["node"], o["node"]

    return _pairs(batches, links)


def sketch(g) -> bytes:
    """Shingles per range of hashes, 255 at most; a power of two of ranges, about half as many as shingles."""
    import numpy as np

    bits = min(12, max(6, (len(g) - 1).bit_length() - 1))
    return np.minimum(np.bincount((g >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def possible(x: bytes, y: bytes, n: int) -> bool:
    """May sets of n shingles in all be similar? They differ in at least the sum of the
    differences per range, and in at most a ninth of n if they are."""
    import numpy as np

    a, b = (np.frombuffer(z, np.uint8).astype(np.int64) for z in sorted((x, y), key=len))
    if a.max() == 255 or b.max() == 255:
        return True
    if len(a) < len(b):
        b = b.reshape(len(a), -1).sum(axis=1)
    return (NUM + DEN) * int(np.abs(a - b).sum()) <= (DEN - NUM) * n


def _possible(batches):
    import pyarrow as pa

    for b in batches:
        ok = [possible(x, y, n) for x, y, n in zip(*(b.column(c).to_pylist() for c in ("a", "b", "n")))]
        yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], ["u", "v"]).filter(pa.array(ok, pa.bool_()))


def _similar(batches):
    import numpy as np
    import pyarrow as pa

    for b in batches:
        ok = []
        for x, y in zip(b.column("a"), b.column("b")):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(DEN * both >= NUM * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], ["u", "v"]).filter(pa.array(ok, pa.bool_()))


def _checked(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose shingles are similar. Only texts of pairs are read again, and only
    shingles of pairs whose sketches allow it travel."""
    import pyarrow as pa

    pairs = durable(pairs.distinct())
    ends = durable(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct())
    if ends.count() <= FEW:  # else the texts are shuffled
        ends = F.broadcast(ends)
    schema = pa.schema([("node", pa.int64()), ("n", pa.int32()), ("sketch", pa.binary()), ("set", pa.binary())])
    sets = durable(texts.join(ends, "node", "left_semi").mapInArrow(_texts(lambda node, g: (node, len(g), sketch(g), g.tobytes()), schema), "node long, n int, sketch binary, set binary"))

    def both(pairs: DataFrame, one: DataFrame, what: str) -> DataFrame:
        a, b = (one.select(F.col("node").alias(e), F.col(what).alias(x), F.col("n").alias(f"n{x}")) for e, x in (("u", "a"), ("v", "b")))
        return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b", (F.col("na") + F.col("nb")).alias("n"))

    pairs = durable(both(pairs, sets.select("node", "n", "sketch").dropDuplicates(["node"]), "sketch").mapInArrow(_possible, "u long, v long"))
    kept = sets.join(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct(), "node", "left_semi").dropDuplicates(["node"])
    return durable(both(pairs, kept, "set").mapInArrow(_similar, "u long, v long"))


def _upto(n):
    return F.sequence(F.lit(0), (n - 1).cast("int"))


def similar_links(texts: DataFrame) -> DataFrame:
    """texts: node (long, equal for equal texts), text. (u, v): links that join all texts of
    similarity 0.8 or more, directly or over others; never two texts below it."""
    import numpy as np
    import pyarrow as pa

    spark = texts.sparkSession
    sampled = pa.schema([("node", pa.int64()), ("gs", pa.list_(pa.int64()))])
    few = texts.where(F.pmod("node", F.lit(SAMPLE)) == 0).mapInArrow(_texts(lambda node, g: (node, g.view(np.int64)), sampled), "node long, gs array<long>")
    few = few.select("node", F.explode("gs").alias("g")).groupBy("g").agg(F.count_distinct("node").alias("n")).where(F.col("n") >= SEEN).orderBy(F.desc("n"), "g").limit(HOT_MOST)
    hot = spark.sparkContext.broadcast(np.sort(np.array([r.g for r in few.collect()], np.int64).view(np.uint64)))
    schema = pa.schema([("node", pa.int64()), ("size", pa.int32()), ("gs", pa.list_(pa.int64())), ("fp", pa.binary())])
    features = durable(texts.mapInArrow(_texts(_features(hot), schema), "node long, size int, gs array<long>, fp binary").dropDuplicates(["node"]))
    rows = features.select("node", "size", F.posexplode("gs").alias("pos", "g"))
    counts = rows.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    shared = durable(rows.join(counts, "g").join(features.select("node", "fp"), "node"))

    cuts = F.ceil(F.col("m") / HOT)
    one, two = (F.pmod(F.xxhash64("node", F.lit(k)), cuts) for k in (1, 2))
    salts = F.when(cuts == 1, F.array(F.lit(0).cast("long"))).otherwise(F.array(one, cuts + two))
    blocks = shared.select("g", F.explode(salts).alias("salt"), "node", "size", "pos", "fp").groupBy("g", "salt").agg(F.collect_list(F.struct("node", "size", "pos", "fp")).alias("e")).select("e")
    first = _checked(texts, blocks.mapInArrow(_nearest, "u long, v long"))

    rooted = shared.join(components(first), "node", "left").withColumn("root", F.coalesce("root", "node"))
    per_root = rooted.groupBy("g", "root").agg(F.count(F.lit(1)).alias("n"))
    top = per_root.groupBy("g").agg(F.max(F.struct("n", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("g", "top")
    rest = rooted.join(top, "g").withColumn("major", F.col("root") == F.col("top.root"))
    seekers, parts = F.ceil((F.col("m") - F.col("top.n")) / HOT), cuts
    mine = lambda n: F.array(F.pmod(F.xxhash64("node"), n).cast("int"))
    fields = ["node", "size", "pos", "fp", "root", "major"]
    held = rest.select("g", *fields, F.explode(_upto(seekers)).alias("a"), F.lit(True).alias("held"), F.lit(False).alias("sought"), mine(parts)[0].alias("c"))
    sought = rest.where("not major").select("g", *fields, F.explode(mine(seekers)).alias("a"), F.lit(False).alias("held"), F.lit(True).alias("sought"), _upto(parts).alias("c")).withColumn("c", F.explode("c"))
    grid = held.unionByName(sought).groupBy("g", "a", "c").agg(F.collect_list(F.struct(*fields, "held", "sought")).alias("e")).select("e")
    return first.unionAll(_checked(texts, grid.mapInArrow(_across, "u long, v long")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every group of near copies, all columns kept: that of the smallest id
    (null last), then of the smallest hash of the text.

    Rows of one id and different texts are different documents; a null id is an id like
    any other. Null and blank texts are near copies of each other. Empty in, empty out."""
    names = docs.columns
    inner = docs.toDF(*(f"c{i}" for i in range(len(names))))  # no name clashes then
    ident = F.col(f"c{names.index(id_col)}")
    text = F.coalesce(F.col(f"c{names.index(text_col)}").cast("string"), F.lit(""))
    hashed = F.xxhash64(text)
    links = similar_links(inner.select(hashed.alias("node"), text.alias("text")))
    rows = durable(inner.select(ident.alias("id"), hashed.alias("node")).groupBy("id", "node").agg(F.count(F.lit(1)).alias("n")))
    rooted = rows.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "node")
    best = rooted.groupBy("root").agg(F.min(order).alias("k"))
    judged = durable(rooted.join(best, "root").select("id", "node", "n", (F.col("k.id").eqNullSafe(F.col("id")) & (F.col("k.node") == F.col("node"))).alias("stays")))
    named = lambda d, x: d.select(F.col("id").alias(f"id{x}"), F.col("node").alias(f"node{x}"))
    same = lambda x: (F.col(f"node{x}") == hashed) & F.col(f"id{x}").eqNullSafe(ident)
    gone = judged.where("not stays")
    if gone.count() <= FEW:  # else the texts are shuffled
        kept = inner.join(F.broadcast(named(gone, 1)), same(1), "left_anti")
    else:
        kept = inner.join(named(judged.where("stays"), 1), same(1), "left_semi")
    more = named(judged.where("stays and n > 1"), 2)
    few = more.count()
    if few:  # of repeated rows one stays, whichever
        more = F.broadcast(more) if few <= FEW else more
        once = kept.join(more, same(2), "left_semi").withColumn("node", hashed).dropDuplicates([f"c{names.index(id_col)}", "node"]).drop("node")
        kept = kept.join(more, same(2), "left_anti").unionByName(once)
    return kept.toDF(*names)
