"""Language-model scores from a log-frequency Bloom filter.

Unigram and bigram counts of all training tokens are merged by hash bucket, of
which there are so many that one holds about PER_BUCKET tokens at any size of
the corpus. Each bucket becomes a filter segment of BITS_PER_ENTRY bits an
entry: an n-gram of count c is entered under the levels 1 .. q(c), q(c) = 1 +
floor(log_BASE c), and its quantised count is read back by probing level after
level until one is missing. P(w | h) = (c'(hw) + MU P1(w)) / (c'(h) + MU), with
smoothed unigram P1; counts are read at the lower end of their level.

Segments stay where they are built. Texts are tokenised once, into chunks of
about CHUNK tokens; a chunk sends its distinct n-grams to their buckets, once,
both to be counted and to be looked up, and gets back one byte of level for
each, and the exact counts of its unigrams, which the exact unigram score beside
it takes. Each text is gone through as often at any size of the corpus, and
neither the error rate of the filter nor the memory of a worker depends on it.

A filter known to be small can be broadcast instead (`pass_bytes`), with the
same scores: then exact counts of at most HEAD frequent tokens are broadcast, too,
and all other tokens are joined with theirs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, is_fold, read, slices, small_batches, trim

BASE = 1.5
HASHES = 4
BITS_PER_ENTRY = 8
PASS_BYTES = 128 << 20
BUCKETS = 32
PER_BUCKET = 1 << 20
HEAD = 1 << 20
MU = 100.0
FLUSH = 4_000_000
CHUNK = 1 << 20
_PACKED = "order int, bucket int, keys binary, counts binary"
#: For rows of some MB that don't compress: as they are, and no page of a hundred.
_LARGE_ROWS = {"compression": "uncompressed", "parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1"}


def tokens_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def hashed(texts: list[str | None]):
    """(hash of each token and the end after each text, hash of what comes before it, tokens per text)."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words, sizes = [], []
    for t in texts:
        w = tokens_of(t)
        w.append(b"")  # the end; no word is empty
        words += w
        sizes.append(len(w))
    known = {w: xxh64_intdigest(w) for w in set(words)}
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    sizes = np.array(sizes, np.int64)
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[np.cumsum(sizes) - sizes] = known.get(b"", 0)  # a text begins after an end
    return h, before, sizes


def bigram_keys(before, h):
    import numpy as np

    return _mix(before * np.uint64(0x9E3779B97F4A7C15) + _mix(h))


def _merge(parts):
    """Sum counts of equal keys over [(keys, counts)]."""
    import numpy as np

    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _count(buckets: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        shift = np.uint64(65 - int(buckets).bit_length())

        def flush(acc):
            for order, parts in acc.items():
                if not parts:
                    continue
                keys, counts = _merge(parts)
                bucket = (keys >> shift).astype(np.int64)
                cut = np.searchsorted(bucket, np.arange(buckets + 1))
                rows = [(i, keys[a:b].tobytes(), counts[a:b].astype(np.int64).tobytes()) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([order] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["order", "bucket", "keys", "counts"])

        acc, held = {1: [], 2: []}, 0
        for batch in batches:
            for b in slices(batch):
                h, before, _ = hashed(b.column("text").to_pylist())
                for order, keys in ((1, h), (2, bigram_keys(before, h))):
                    k, c = np.unique(keys, return_counts=True)
                    acc[order].append((k, c))
                    held += len(k)
                if held > FLUSH:
                    yield from flush(acc)
                    acc, held = {1: [], 2: []}, 0
        yield from flush(acc)

    return run


def levels(counts):
    """q(c) of positive counts."""
    import numpy as np

    return 1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64)


def level_count(q):
    """The least count of level q (0 for none)."""
    import numpy as np

    q = np.asarray(q)
    return np.where(q > 0, np.ceil(BASE ** (q - 1.0) - 1e-9), 0.0)


def _places(keys, level: int, size: int):
    """Bit positions of (key, level) in a segment of `size` bits."""
    import numpy as np

    a = _mix(keys + np.uint64(level * 0xD6E8FEB86659FD93 % (1 << 64)))
    step = (a >> np.uint64(32)) | np.uint64(1)
    low = a & np.uint64(0xFFFFFFFF)
    for i in range(HASHES):
        yield ((low + np.uint64(i) * step) & np.uint64(0xFFFFFFFF)) * np.uint64(size) >> np.uint64(32)


def segment(keys, counts, max_bits: int = 1 << 32, bits_per_entry: int = BITS_PER_ENTRY):
    """Filter segment (bytes) of one bucket; positions have 32 bits."""
    import numpy as np

    q = levels(counts)
    size = int(min(max_bits, max(64, int(q.sum()) * bits_per_entry))) // 8 * 8
    bits = np.zeros(size, bool)
    for j in range(1, int(q.max(initial=0)) + 1):
        for at in _places(keys[q >= j], j, size):
            bits[at] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _reduce(bits_per_entry: int):
    def run(key, table):
        import numpy as np
        import pyarrow as pa

        order, bucket = key[0].as_py(), key[1].as_py()
        parts = [(np.frombuffer(k, np.uint64), np.frombuffer(c, np.int64)) for k, c in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist())]
        keys, counts = _merge(parts)
        bits = segment(keys, counts, bits_per_entry=bits_per_entry)
        full = order == 1
        return pa.table(
            {
                "order": pa.array([order], pa.int32()),
                "bucket": pa.array([bucket], pa.int32()),
                "bits": pa.array([bits], pa.binary()),
                "ones": pa.array([int(np.bitwise_count(np.frombuffer(bits, np.uint8)).sum())], pa.int64()),
                "keys": pa.array([keys.tobytes() if full else None], pa.binary()),
                "counts": pa.array([counts.tobytes() if full else None], pa.binary()),
                "distinct": pa.array([len(keys)], pa.int64()),
                "total": pa.array([int(counts.sum())], pa.int64()),
                "by_level": pa.array([np.bincount(levels(counts), minlength=128)[:128].tolist() if full else []], pa.list_(pa.int64())),
            }
        )

    return run


@dataclass
class LogBloom:
    """Quantised n-gram counts; offsets and sizes (bytes, bits) per (order, bucket)."""

    data: object
    offset: object
    size: object
    buckets: int
    total: int
    distinct: int

    def read(self, order: int, keys):
        """Quantised counts of the keys."""
        return level_count(self.read_levels(order, keys))

    def read_levels(self, order: int, keys):
        """Levels of the keys, by repeated membership probes."""
        import numpy as np

        bucket = (keys >> np.uint64(65 - int(self.buckets).bit_length())).astype(np.int64)
        base, size = self.offset[order - 1][bucket] * 8, self.size[order - 1][bucket].astype(np.uint64)
        q = np.zeros(len(keys), np.int64)
        todo = np.flatnonzero(size > 0)
        level = 1
        while len(todo) and level < 128:
            k, b, s = keys[todo], base[todo], size[todo]
            there = np.ones(len(todo), bool)
            for at in _places(k, level, s):
                at = at.astype(np.int64) + b
                there &= (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            todo = todo[there]
            q[todo] = level
            level += 1
        return q

    def log_terms(self, h, before, mu: float):
        """log10 P of each token."""
        import numpy as np

        uni, back = np.unique(np.concatenate((h, before)), return_inverse=True)
        c1 = self.read(1, uni)
        two, back2 = np.unique(bigram_keys(before, h), return_inverse=True)
        return log_p(c1[back[: len(h)]], c1[back[len(h) :]], self.read(2, two)[back2], self.total, self.distinct, mu)


def log_p(word, history, both, total: int, distinct: int, mu: float):
    """log10 P(w | h) by the quantised counts of w, h and hw."""
    import numpy as np

    p1 = np.minimum(1, (word + 0.5) / (total + 0.5 * (distinct + 1)))
    return np.log10(np.minimum(both, word) + mu * p1) - np.log10(history + mu)


def count_ngrams(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, bits_per_entry: int = BITS_PER_ENTRY) -> DataFrame:
    """One row per (order, bucket): filter segment; for unigrams the exact counts, too."""
    d = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    packed = d.mapInArrow(_count(buckets), _PACKED)
    schema = "order int, bucket int, bits binary, ones long, keys binary, counts binary, distinct long, total long, by_level array<long>"
    return durable(packed.groupBy("order", "bucket").applyInArrow(_reduce(bits_per_entry), schema))


def passes(counted: DataFrame, pass_bytes: int = PASS_BYTES) -> list[tuple[tuple[int, int], tuple[int, int], bool]]:
    """[(unigram buckets, bigram buckets, first with these unigrams)], ranges from, to; the
    segments of each take at most `pass_bytes` (a single one may take more)."""
    cuts: dict[int, list[int]] = {1: [0], 2: [0]}
    held = {1: 0, 2: 0}
    for r in counted.select("order", "bucket", F.octet_length("bits").alias("n")).orderBy("order", "bucket").toLocalIterator():
        if held[r.order] and held[r.order] + r.n > pass_bytes:
            cuts[r.order].append(r.bucket)
            held[r.order] = 0
        held[r.order] += r.n
    runs = [list(zip(c, [*c[1:], 1 << 31])) for c in cuts.values()]
    return [(u, b, k == 0) for u in runs[0] for k, b in enumerate(runs[1])]


def load(counted: DataFrame, buckets: int = BUCKETS) -> LogBloom:
    """The whole filter, fetched by the driver segment after segment."""
    import numpy as np

    parts: list[bytes] = []
    offset, size = np.zeros((2, buckets), np.int64), np.zeros((2, buckets), np.int64)
    at = 0
    for r in counted.select("order", "bucket", "bits").toLocalIterator():
        offset[r.order - 1, r.bucket], size[r.order - 1, r.bucket] = at, 8 * len(r.bits)
        parts.append(bytes(r.bits))
        at += len(r.bits)
    s = counted.where("order = 1").agg(F.sum("total"), F.sum("distinct")).first()
    return LogBloom(np.frombuffer(b"".join(parts), np.uint8), offset, size, buckets, s[0] or 0, s[1] or 0)


def false_rate(counted: DataFrame) -> float:
    """Chance that a probe for what was not entered says yes: from the bits set, weighed by entries."""
    size = F.col("size") if "size" in counted.columns else 8 * F.octet_length("bits")
    rate = F.pow(F.col("ones") / size, HASHES)
    return counted.agg(F.sum(rate * F.col("distinct")) / F.sum("distinct")).first()[0] or 0.0


def _unpack(least: int, most: int):
    """(hash, n) of the unigrams with least <= n < most."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for k, c in zip(b.column("keys").to_pylist(), b.column("counts").to_pylist()):
                keys, n = np.frombuffer(k, np.int64), np.frombuffer(c, np.int64)
                ok = (n >= least) & (n < most)
                yield pa.RecordBatch.from_arrays([pa.array(keys[ok]), pa.array(n[ok])], ["hash", "n"])

    return run


def _base(head, model, mu: float):
    """Tokens, known ones and their logarithms by the head; the other tokens; the score."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        keys, logs = head.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for b in slices(batch, 2 << 20):
                h, before, n = hashed(b.column("text").to_pylist())
                ends = np.cumsum(n)
                begin = ends - n
                at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
                known = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                base = np.add.reduceat(np.where(known, logs[at], 0.0) if len(keys) else np.zeros(len(h)), begin)
                rest = np.concatenate(([0], np.cumsum(~known)))
                tail = pa.ListArray.from_arrays(pa.array(np.concatenate((rest[begin], rest[-1:])).astype(np.int32)), pa.array(h[~known].view(np.int64)))
                score = pa.array(np.add.reduceat(model.value.log_terms(h, before, mu), begin))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("held_out"), pa.array(row + np.arange(len(n))), pa.array(n), pa.array(np.add.reduceat(known.astype(np.int64), begin)), pa.array(base), score, tail],
                    ["doc_id", "held_out", "row", "n_tokens", "n_known", "logs", "score", "tail"],
                )
                row += len(n)

    return run


def planes(x) -> bytes:
    """The numbers' first bytes, then their second ones, ...: small numbers compress well so."""
    import numpy as np

    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def from_planes(b, kind):
    import numpy as np

    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def gaps(keys):
    """The first key, then differences (modulo 2^64); undone by a cumulative sum."""
    out = keys.copy()
    out[1:] -= keys[:-1]
    return out


def _chunks(size: int):
    """(doc_id, held_out, text) -> one row per chunk: hashes of its distinct tokens, frequent ones
    first, its tokens as places among these, and its documents with their numbers of tokens."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        def row():
            uni, codes = np.unique(np.concatenate([h for _, h, _ in acc]), return_inverse=True)
            order = np.argsort(-np.bincount(codes), kind="stable")
            rank = np.empty(len(uni), np.uint32)
            rank[order] = np.arange(len(uni), dtype=np.uint32)
            d = pa.Table.from_batches([b.append_column("n", pa.array(n)) for b, _, n in acc]).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, d.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(d)
            cells = pa.compress(planes(gaps(uni[order])), "zstd", asbytes=True), pa.compress(planes(rank[codes]), "zstd", asbytes=True), sink.getvalue().to_pybytes()
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *(pa.array([x], pa.binary()) for x in cells)], ["chunk", "keys", "tokens", "docs"])

        chunk = TaskContext.get().partitionId() << 32
        acc, tokens = [], 0
        for batch in batches:
            for b in slices(batch, 2 << 20):
                h, _, n = hashed(b.column("text").to_pylist())
                acc.append((b.select(["doc_id", "held_out"]), h, n))
                tokens += len(h)
                if tokens >= size:
                    yield row()
                    chunk += 1
                    acc, tokens = [], 0
        if acc:
            yield row()

    return run


def _open(keys: bytes, tokens: bytes, docs: bytes):
    """(documents, tokens per document, distinct tokens and places among them, the places of what
    comes before, distinct bigrams and places among them) of a chunk."""
    import numpy as np
    import pyarrow as pa

    d = pa.ipc.open_stream(docs).read_all().combine_chunks()
    sizes = d.column("n").to_numpy()
    ranks = from_planes(pa.decompress(tokens, 4 * int(sizes.sum()), "zstd"), np.uint32)
    uni = np.cumsum(from_planes(pa.decompress(keys, 8 * (int(ranks.max()) + 1), "zstd"), np.uint64), dtype=np.uint64)
    order = np.argsort(uni)
    place = np.empty(len(uni), np.int64)
    place[order] = np.arange(len(uni))
    uni, codes = uni[order], place[ranks]
    before = np.empty_like(codes)
    before[1:] = codes[:-1]
    before[np.cumsum(sizes) - sizes] = codes[-1]  # a text begins after an end
    two, pairs = np.unique(bigram_keys(uni[before], uni[codes]), return_inverse=True)
    return d, sizes, uni, codes, before, two, pairs


def _ask(buckets: int):
    """Chunks -> (chunk, order, bucket, distinct n-grams, their numbers in texts to learn from)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        shift = np.uint64(65 - int(buckets).bit_length())
        for batch in batches:
            for chunk, *cells in zip(*(batch.column(i).to_pylist() for i in range(4))):
                d, sizes, uni, codes, _, two, pairs = _open(*cells)
                learn = np.repeat(~d.column("held_out").fill_null(True).to_numpy(), sizes)
                for order, keys, at in ((1, uni, codes), (2, two, pairs)):
                    counts = np.bincount(at[learn], minlength=len(keys)).astype(np.uint32)
                    cut = np.searchsorted((keys >> shift).astype(np.int64), np.arange(buckets + 1))
                    some = np.flatnonzero(np.diff(cut))
                    a, b = cut[some].tolist(), cut[some + 1].tolist()
                    n, step = len(some), gaps(keys)
                    step[cut[some]] = keys[cut[some]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([chunk] * n, pa.int64()), pa.array([order] * n, pa.int32()), pa.array(some.astype(np.int32)), pa.array([planes(step[i:j]) for i, j in zip(a, b)], pa.binary()), pa.array([planes(counts[i:j]) for i, j in zip(a, b)], pa.binary())],
                        ["chunk", "order", "bucket", "keys", "counts"],
                    )
            trim()

    return run


def _answer(bits_per_entry: int):
    """One bucket: its segment is built and read for all chunks; a row for each with the levels
    (and exact counts, of unigrams) of what it sent, and one without a chunk on the segment."""

    def run(key, table):
        import numpy as np
        import pyarrow as pa

        order = key[0].as_py()
        sent = [np.cumsum(from_planes(x, np.uint64), dtype=np.uint64) for x in table.column("keys").to_pylist()]
        every, back = np.unique(np.concatenate(sent), return_inverse=True)
        counts = np.bincount(back, np.concatenate([from_planes(x, np.uint32) for x in table.column("counts").to_pylist()])).astype(np.int64)
        new = counts > 0
        bits = np.frombuffer(segment(every[new], counts[new], bits_per_entry=bits_per_entry), np.uint8)
        one = LogBloom(bits, np.zeros((2, 1), np.int64), np.full((2, 1), 8 * len(bits)), 1, 0, 0)
        levels_, exact = one.read_levels(order, every).astype(np.uint8)[back], counts[back]
        ends = np.cumsum([len(k) for k in sent]).tolist()
        spans, n = list(zip([0, *ends[:-1]], ends)), len(sent)
        trim()
        return pa.table(
            {
                "chunk": pa.array([*table.column("chunk").to_pylist(), None], pa.int64()),
                "order": pa.array([order] * (n + 1), pa.int32()),
                "bucket": pa.array([key[1].as_py()] * (n + 1), pa.int32()),
                "levels": pa.array([*(levels_[a:b].tobytes() for a, b in spans), None], pa.binary()),
                "exact": pa.array([*(exact[a:b].tobytes() if order == 1 else None for a, b in spans), None], pa.binary()),
                "ones": pa.array([None] * n + [int(np.bitwise_count(bits).sum())], pa.int64()),
                "size": pa.array([None] * n + [8 * len(bits)], pa.int64()),
                "distinct": pa.array([None] * n + [int(new.sum())], pa.int64()),
                "total": pa.array([None] * n + [int(counts.sum())], pa.int64()),
            }
        )

    return run


def _finish(total: int, distinct: int, mu: float):
    """One chunk and what came back for it -> its documents' scores."""

    def run(key, table):
        import numpy as np
        import pyarrow as pa

        order, bucket = table.column("order").to_numpy(), table.column("bucket").to_numpy()
        first, second = table.column("first").to_pylist(), table.column("second").to_pylist()
        by = np.lexsort((bucket, order)).tolist()  # buckets are ranges of hashes
        d, sizes, uni, codes, before, two, pairs = _open(first[by[0]], second[by[0]], table.column("docs")[by[0]].as_py())
        level = [np.frombuffer(b"".join(first[i] for i in by if order[i] == o), np.uint8) for o in (1, 2)]
        exact = np.frombuffer(b"".join(second[i] for i in by if order[i] == 1), np.int64)
        if [len(x) for x in (*level, exact)] != [len(uni), len(two), len(uni)]:
            raise ValueError("a chunk's answers are not those to its questions")
        some = np.empty(len(two), np.int64)
        some[pairs] = np.arange(len(pairs))  # a place of each bigram
        c1, c2 = level_count(np.arange(256))[level[0]], level_count(np.arange(256))[level[1]]
        logs = log_p(c1[codes[some]], c1[before[some]], c2, total, distinct, mu)
        begin = np.cumsum(sizes) - sizes
        base = np.log10((exact + 0.5) / (total + 0.5 * (distinct + 1)))
        trim()
        return pa.table(
            {
                "doc_id": d.column("doc_id"),
                "held_out": d.column("held_out"),
                "n_tokens": pa.array(sizes),
                "n_known": pa.array(np.add.reduceat((exact > 0).astype(np.int64)[codes], begin)),
                "base_score": pa.array(np.add.reduceat(base[codes], begin)),
                "score": pa.array(np.minimum(0.0, np.add.reduceat(logs[pairs], begin))),
            }
        )

    return run


def score_in_place(docs: DataFrame, held_out, id_col="doc_id", text_col="text", mu: float = MU, buckets: int = BUCKETS, bits_per_entry: int = BITS_PER_ENTRY, chunk_tokens: int = CHUNK) -> DataFrame:
    """score_documents(), with no filter outside the task that built it."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), text.alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    small_batches(docs.sparkSession)
    chunks = durable(d.mapInArrow(_chunks(chunk_tokens), "chunk long, keys binary, tokens binary, docs binary"), **_LARGE_ROWS)
    asked = chunks.mapInArrow(_ask(buckets), "chunk long, order int, bucket int, keys binary, counts binary")
    schema = "chunk long, order int, bucket int, levels binary, exact binary, ones long, size long, distinct long, total long"
    answers = durable(asked.groupBy("order", "bucket").applyInArrow(_answer(bits_per_entry), schema))
    segments = answers.where("chunk is null")
    s = segments.where("order = 1").agg(F.sum("total"), F.sum("distinct")).first()
    total, distinct = s[0] or 0, s[1] or 0
    own = chunks.select("chunk", F.lit(0).alias("order"), F.lit(0).alias("bucket"), F.col("keys").alias("first"), F.col("tokens").alias("second"), "docs")
    back = answers.where("chunk is not null").select("chunk", "order", "bucket", F.col("levels").alias("first"), F.col("exact").alias("second"), F.lit(None).cast("binary").alias("docs"))
    rows = own.unionByName(back)
    out = rows.groupBy("chunk").applyInArrow(_finish(total, distinct, mu), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", F.lit(float(false_rate(segments))).alias("filter_false_rate")
    )


def score_documents(
    docs: DataFrame, held_out, id_col="doc_id", text_col="text", mu: float = MU, head_size: int = HEAD, buckets: int = BUCKETS, pass_bytes: int = PASS_BYTES, bits_per_entry: int = BITS_PER_ENTRY
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, and
    filter_false_rate (measured on the filter, the same in each row), per input row.

    held_out: boolean column; the other rows are learned from. A null or blank
    text is its end alone; repeated rows count (and are scored) each; without
    training rows every token is unknown; an empty table gives an empty result.
    A score is at most 0. Runs its jobs but the last while it is planned.

    The filter is broadcast if an order of it takes at most `pass_bytes`, else read in
    place; 0: that at once. The scores are the same."""
    import numpy as np

    sc = docs.sparkSession.sparkContext
    counted = count_ngrams(docs.where(~held_out), text_col, buckets, bits_per_entry) if pass_bytes else None
    if counted is None or len(passes(counted, pass_bytes)) > 1:
        return score_in_place(docs, held_out, id_col, text_col, mu, buckets, bits_per_entry)
    uni = counted.where("order = 1").select("keys", "counts")
    by_level = np.zeros(129, np.int64)
    more_of = counted.where("order = 1").select(F.posexplode("by_level").alias("q", "n")).groupBy("q").agg(F.sum("n").alias("n"))
    for r in more_of.collect():  # 128 rows
        by_level[r.q] = r.n
    more = np.cumsum(by_level[::-1])[::-1]  # tokens of level q and above
    q = int(np.argmax(more <= head_size))
    least = int(level_count(q)) if q else 1
    head = [(r.hash, r.n) for r in uni.mapInArrow(_unpack(least, 1 << 62), "hash long, n long").toLocalIterator()]  # at most head_size
    keys = np.array([k for k, _ in head], np.int64).view(np.uint64)
    logs = np.log10(np.array([n for _, n in head], np.float64) + 0.5)
    order = np.argsort(keys)
    head = sc.broadcast((keys[order], logs[order]))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), text.alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, row long, n_tokens long, n_known long, logs double, score double, tail array<long>"
    model = load(counted, buckets)
    scored = durable(d.mapInArrow(_base(head, sc.broadcast(model), mu), schema))
    tail = uni.mapInArrow(_unpack(1, least), "hash long, n long")
    seen = scored.select("row", F.explode("tail").alias("hash")).join(tail, "hash", "left")
    per_row = seen.groupBy("row").agg(F.count("n").alias("more"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("tail_logs"))
    norm = F.lit(float(np.log10(model.total + 0.5 * (model.distinct + 1))))
    return scored.join(per_row, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("tail_logs", F.lit(0.0)) - F.col("n_tokens") * norm).alias("base_score"), F.least(F.lit(0.0), "score").alias("score"),
        F.lit(float(false_rate(counted))).alias("filter_false_rate"),
    )


def buckets_for(docs: DataFrame, text_col: str = "text") -> int:
    """A power of two, at least BUCKETS, of which each holds PER_BUCKET tokens or fewer, at
    the four bytes that a token takes at least on average; the sizes of all texts are summed."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(BUCKETS, 1 << max(0, int(size // (4 * PER_BUCKET))).bit_length())


def op6_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score_documents(docs, is_fold("doc_id", 5), buckets=buckets_for(docs), pass_bytes=0)
