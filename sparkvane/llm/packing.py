"""Best-fit packing of token sequences by bin completion.

Texts are tokenised where they lie; pieces, with their rank among the pieces
of equal length in their partition, are written once. What the driver sees is
the histogram of piece lengths: at most `capacity` rows at any corpus size.
Over it runs bin completion: the incumbent is the better of best-fit decreasing
and of giving the largest piece left its filling of least waste, as often as
the counts allow; where that needs more than the lower bound, branch and bound goes over the undominated fillings of
the largest piece, pruned by the waste that the wanted number of sequences has
to spare, within a fixed number of steps. The resulting runs (size, rank range -> sequences)
place every piece by a binary search; no group is ever gathered in one task.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import durable, fold, read, slices
from .wordbpe import text_tokenizer

CAPACITY = 4096
END_ID = 1
#: steps of the search over packings; size counts up to which it remembers states and tries other orders
STEPS = 400_000
FEW = 64


def _pieces(path: str, capacity: int):
    end = END_ID.to_bytes(4, "little")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, seen, tok = TaskContext.get().partitionId(), {}, text_tokenizer(path)
        for batch in batches:
            for b in slices(batch):
                rows, piece, start, length, crc, rank = [], [], [], [], [], []
                for i, ids in enumerate(tok.encode_all(b.column("text").to_pylist())):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        p = ids[at : at + 4 * capacity]
                        n = len(p) // 4
                        rows.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(n)
                        crc.append(zlib.crc32(p))
                        rank.append(seen.get(n, 0))
                        seen[n] = rank[-1] + 1
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array([part] * len(rows), pa.int32()), pa.array(rank, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"],
                )

    return run


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part, local_rank; written to the shared
    folder, as its ranks must not change on a retry."""
    d = fold(docs, id_col, text_col)
    kind = d.schema["doc_id"].dataType.simpleString()
    return durable(d.mapInArrow(_pieces(tokenizer_path, capacity), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, local_rank long"))


def complete_bin(left: dict[int, int], sizes: list[int], room: int, max_nodes: int = 20_000) -> list[int]:
    """The filling of `room` of least waste from `sizes` (descending; left[s] pieces each).

    The first filling without waste in depth-first order, best fit first; if there is
    none, or none within `max_nodes` steps, the best sum comes from the table of all
    sums (one bit each), which has no limit."""
    spend = [max_nodes]
    for fill in _fillings(left, sizes, room, 0, spend):
        return [s for s, k in fill.items() for _ in range(k)]
    return _best_sum(left, sizes, room)


def _best_sum(left: dict[int, int], sizes: list[int], room: int) -> list[int]:
    """Largest sum up to `room`: bits of an integer are the sums that can be had."""
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for s in sizes:
        n, k = min(left[s], room // s), 1
        while n > 0:
            k = min(k, n)
            steps.append((s, k, reach))
            reach |= reach << s * k & mask
            n, k = n - k, 2 * k
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, []
    for s, k, before in reversed(steps):
        if not before >> at & 1:
            out += [s] * k
            at -= s * k
    return sorted(out, reverse=True)


def _fillings(left: dict[int, int], sizes: list[int], room: int, slack: int, spend: list[int], less: int = 0):
    """Undominated fillings {size: pieces} of `room` that waste at most `slack`, depth
    first in the order of `sizes`, as many copies as fit first. One piece of size `less`
    is not to be had. A step takes all copies of a size at once; spend[0] steps at most."""
    n = len(sizes)
    have = [left[s] - (s == less) for s in sizes]
    tail, least = [0] * (n + 1), [room + 1] * (n + 1)
    for i in range(n - 1, -1, -1):
        tail[i] = tail[i + 1] + sizes[i] * have[i]
        least[i] = min(least[i + 1], sizes[i]) if have[i] > 0 else least[i + 1]
    path: list[list[int]] = []  # [position, copies]
    i, free = 0, room
    while spend[0] > 0:
        spend[0] -= 1
        if free >= least[i] and free - tail[i] <= slack:
            while sizes[i] > free or not have[i]:
                i += 1
            k = min(have[i], free // sizes[i])
            path.append([i, k])
            free -= k * sizes[i]
            i += 1
            continue
        if free <= slack:
            used = dict(path)
            if free < least[0] or not any(s <= free and have[j] > used.get(j, 0) for j, s in enumerate(sizes)):
                yield {sizes[j]: k for j, k in path}
        if not path:
            return
        j = path[-1][0]
        path[-1][1] -= 1
        free += sizes[j]
        if not path[-1][1]:
            path.pop()
        i = j + 1


def lower_bound(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """Bins that any packing needs (Martello and Toth's L2)."""
    import numpy as np

    n = np.zeros(capacity + 1, np.int64)
    for s, k in counts.items():
        n[s] = k
    many, tokens = np.cumsum(n), np.cumsum(n * np.arange(capacity + 1))
    half = capacity // 2
    a = np.arange(1, half + 1)  # pieces under a are left out
    big, big_tokens = many[capacity - a] - many[half], tokens[capacity - a] - tokens[half]
    rest = tokens[half] - tokens[a - 1] - (big * capacity - big_tokens)
    whole = many[capacity] - many[half]
    return int(max(-(-tokens[capacity] // capacity), whole + np.maximum(0, -(-rest // capacity)).max(initial=0)))


def _moves(left: dict[int, int], sizes: list[int], capacity: int, slack: int, spend: list[int]):
    """(filling, sequences, waste) for the largest piece left, many sequences at once first."""
    live = [s for s in sizes if left[s]]
    big = max(live)
    for fill in _fillings(left, live, capacity - big, slack, spend, big):
        fill[big] = fill.get(big, 0) + 1
        waste = capacity - sum(s * k for s, k in fill.items())
        m = min(left[s] // k for s, k in fill.items())
        if waste:
            m = min(m, slack // waste)
        while m:
            yield fill, m, m * waste
            m //= 2


def _search(counts: dict[int, int], sizes: list[int], capacity: int, bins: int, spend: list[int]):
    """A packing into `bins` sequences, by branching over the fillings of the largest piece
    left; a branch ends when its waste passes what `bins` sequences have to spare."""
    left = dict(counts)
    slack = bins * capacity - sum(s * n for s, n in counts.items())
    seen: set[tuple] = set()
    plan: list[tuple] = []
    frames = [_moves(left, sizes, capacity, slack, spend)]
    while frames and spend[0] > 0:
        move = next(frames[-1], None)
        if move is None:
            frames.pop()
            if plan:
                fill, m, waste = plan.pop()
                slack += waste
                for s, k in fill.items():
                    left[s] += m * k
            continue
        fill, m, waste = move
        for s, k in fill.items():
            left[s] -= m * k
        slack -= waste
        plan.append((dict(fill), m, waste))
        if not any(left.values()):
            return [(f, m) for f, m, _ in plan]
        state = (slack, *left.values()) if len(sizes) <= FEW else None
        if state in seen:
            frames.append(iter(()))
        else:
            if state:
                seen.add(state)
            frames.append(_moves(left, sizes, capacity, slack, spend))
    return None


def _greedy(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Largest piece first, each with its filling of least waste, used as often as can be."""
    from bisect import bisect_left
    from collections import Counter

    left = {s: n for s, n in counts.items() if n > 0}
    neg = sorted(-s for s in left)
    out = []
    while neg:
        big = -neg[0]
        left[big] -= 1
        room = capacity - big
        sizes = [-s for s in neg[bisect_left(neg, -room) :] if left[-s] > 0]
        fill = complete_bin(left, sizes, room) if room and sizes else []
        left[big] += 1
        bin_ = Counter([big, *fill])
        m = min(left[s] // k for s, k in bin_.items())
        out.append((dict(bin_), m))
        for s, k in bin_.items():
            left[s] -= m * k
            if not left[s]:
                del left[s]
                del neg[bisect_left(neg, -s)]
    return out


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over the counts: each piece into the fullest sequence that holds it."""
    from bisect import bisect_left, insort

    rooms: list[int] = []  # distinct free rooms, ascending
    groups: dict[int, list[tuple[dict[int, int], int]]] = {}

    def put(room: int, fill: dict[int, int], m: int) -> None:
        if m:
            if room not in groups:
                insort(rooms, room)
            groups.setdefault(room, []).append((fill, m))

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n > 0:
            at = bisect_left(rooms, s)
            if at < len(rooms):
                room = rooms[at]
                fill, m = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, fill, m = capacity, {}, n  # new sequences, as many as are needed
            k = room // s  # a sequence that took a piece is the fullest that holds the next
            full = min(m, n // k)
            put(room - k * s, {**fill, s: fill.get(s, 0) + k}, full)
            n -= full * k
            rest = n if full < m and 0 < n < k else 0
            if rest:
                put(room - rest * s, {**fill, s: fill.get(s, 0) + rest}, 1)
                n = 0
            if fill:
                put(room, fill, m - full - (rest > 0))
    return [x for g in groups.values() for x in g]


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> list[tuple[dict[int, int], int]]:
    """[(filling {size: pieces}, sequences)] using up all counts.

    The incumbent is the better of best-fit decreasing and of the packing that gives the
    largest piece left its filling of least waste. Where it needs more than the lower
    bound, branch and bound looks for packings of the bound and up, in several orders of
    the sizes. It takes `steps` steps in all; what is not found by then stays with the
    incumbent, so the result is never worse than best-fit decreasing."""
    import random

    counts = {s: n for s, n in sorted(counts.items(), reverse=True) if n > 0}
    best = min(best_fit(counts, capacity), _greedy(counts, capacity), key=lambda plan: sum(m for _, m in plan))
    have, low = sum(m for _, m in best), lower_bound(counts, capacity)
    down = list(counts)
    orders = [down]
    if len(down) <= FEW:
        rng = random.Random(len(down))
        orders += [down[::-1], *(rng.sample(down, len(down)) for _ in range(6))]
    gap = 0
    while low + gap < have and steps > 0:
        for order in orders:
            spend = [min(steps, STEPS // 40)]
            steps -= spend[0]
            plan = _search(counts, order, capacity, low + gap, spend)
            steps += spend[0]
            if plan:
                return plan
        gap = 2 * gap or gap + 1
    return best


def placement(plan: list[tuple[dict[int, int], int]]):
    """Arrays of runs sorted by (size, first rank): first key, first sequence, offset, pieces per sequence."""
    import numpy as np

    used: dict[int, int] = {}
    rows, seq = [], 0
    for bin_, m in plan:
        off = 0
        for s in sorted(bin_, reverse=True):
            rows.append((s << 48 | used.get(s, 0), seq, off, bin_[s]))
            used[s] = used.get(s, 0) + m * bin_[s]
            off += s * bin_[s]
        seq += m
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows)) if rows else tuple(np.zeros(0, np.int64) for _ in range(4))


def _assign(bc):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        key, seq, off, per = bc.value
        for b in batches:
            size, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            want = size << 48 | rank
            k = np.searchsorted(key, want, side="right") - 1
            j = want - key[k]
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq[k] + j // per[k]), pa.array(off[k] + j % per[k] * size)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or blank text is one piece holding the end id alone; only documents
    longer than `capacity` are cut; equal rows are packed each on its own; an
    empty table gives an empty result; other columns are ignored."""
    p = pieces(docs, tokenizer_path, capacity, id_col, text_col)
    per_part = p.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r.length: r.n for r in p.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    bc = docs.sparkSession.sparkContext.broadcast(placement(pack_histogram(histogram, capacity)))
    ranked = p.join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("local_rank"))
    kind = p.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(_assign(bc), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_packing(spark, sf_dir: str, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path(tokenizer))
