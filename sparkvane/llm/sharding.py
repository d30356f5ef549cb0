"""Balanced shards: minimax contiguous partition over ordered atomic groups.

Groups (equal texts) are ordered by a 62-bit hash. The smallest capacity for
which filling shards left to right needs at most k of them is found by binary
search on the driver, over a histogram of the hash order: 4096 bins at first,
then only the bins in which a cut can still fall, 1024 sub-bins each, down to
single groups. So the driver holds some thousand rows at any size, the
capacity is exact, and a row finds its shard by comparing its hash with k - 1
constants. Slots are numbered in two levels, per (shard, bucket of rows), so
no task numbers a whole shard or a hot group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, fold, read

WIDTH, FIRST, STEP = 62, 12, 10
BUCKETS = 1024


@dataclass(frozen=True, order=True)
class Bin:
    """Consecutive groups of the hash order; one group is atomic."""

    first: int  # least hash in it
    size: int
    groups: int
    level: int  # bits that name it

    @property
    def open(self) -> bool:
        return self.groups > 1


def fill(bins: list[Bin], capacity: int, split_open: bool) -> list[int]:
    """Bin in which each shard but the last ends, left to right. Open bins are taken
    whole, or (split_open) to any part, as if their groups were as small as can be."""
    ends, room, i = [], capacity, 0
    rest = bins[0].size if bins else 0
    while i < len(bins):
        if rest <= room:
            room -= rest
            i += 1
            rest = bins[i].size if i < len(bins) else 0
            continue
        if split_open and bins[i].open:
            rest -= room
        elif rest > capacity:
            raise ValueError("a whole bin exceeds the capacity")
        ends.append(i)
        room = capacity
    return ends


def least(bins: list[Bin], k: int, split_open: bool) -> int:
    """Smallest feasible capacity, by binary search with a greedy check."""
    lo = max([1, *(b.size for b in bins if not (split_open and b.open))])
    hi = max(lo, sum(b.size for b in bins))
    while lo < hi:
        mid = (lo + hi) // 2
        if len(fill(bins, mid, split_open)) < k:
            hi = mid
        else:
            lo = mid + 1
    return lo


def undecided(bins: list[Bin], k: int) -> list[Bin]:
    """Open bins that may hold a cut of the best partition: first those larger than
    the lower bound, then those between a cautious and a generous filling."""
    if not bins:
        return []
    low = least(bins, k, True)
    large = [b for b in bins if b.open and b.size > low]
    if large:
        return large
    high = least(bins, k, False)
    late, early = fill(bins, high, True), fill(bins, low, False)
    late += [len(bins) - 1] * (k - 1 - len(late))
    early += [len(bins) - 1] * (k - 1 - len(early))
    spans = {i for a, b in zip(early[: k - 1], late) for i in range(a, b + 1)}
    return [bins[i] for i in sorted(spans) if bins[i].open]


def cut_points(groups: DataFrame, k: int) -> tuple[list[int], int]:
    """(hashes at which shards 2, 3.. begin, capacity). groups: g (0 <= g < 2^62), bytes."""

    def histogram(df: DataFrame, level: int) -> list[Bin]:
        b = F.shiftright("g", WIDTH - level)
        rows = df.groupBy(b.alias("b")).agg(F.min("g").alias("first"), F.sum("bytes").alias("size"), F.count(F.lit(1)).alias("n")).collect()
        return [Bin(r.first, r.size, r.n, level) for r in rows]

    bins = sorted(histogram(groups, FIRST))
    while todo := undecided(bins, k):
        level = min(b.level for b in todo)
        todo = [b for b in todo if b.level == level]
        names = [b.first >> (WIDTH - level) for b in todo]
        finer = histogram(groups.where(F.shiftright("g", WIDTH - level).isin(names)), level + STEP)
        bins = sorted(set(bins) - set(todo) | set(finer))
    capacity = least(bins, k, False)
    return [bins[i].first for i in fill(bins, capacity, False)], capacity


def _number(g: Column, cuts: list[int]) -> Column:
    """Shard of a group, by the cuts at or below it."""
    return sum(((g >= c).cast("int") for c in cuts), F.lit(0)).cast("int")


def shard(docs: DataFrame, k: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, g (group hash), shard, slot (gapless from 0 per shard).

    Equal texts share a shard; the largest shard is as small as the order of
    groups allows. A null text has size 1 and CRC 0 and groups with other nulls,
    apart from empty texts. Repeated rows get a slot each. An empty table gives
    an empty result; with fewer groups than shards some shards stay empty."""
    d = fold(docs, id_col, text_col, None)
    rows = durable(
        d.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64("text"), 64 - WIDTH).alias("g"),
        )
    )
    groups = durable(rows.groupBy("g").agg(F.sum("size").alias("bytes")))
    cuts, _ = cut_points(groups, k)
    rows = rows.withColumn("shard", _number(F.col("g"), cuts)).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "g"), F.lit(BUCKETS)).cast("int"))
    n = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))  # at most k * BUCKETS rows
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = n.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "g")) - 1
    out = rows.withColumn("place", place).join(F.broadcast(base), ["shard", "bucket"])
    return out.select("doc_id", "size", "text_crc32", "g", "shard", (F.col("base") + F.col("place")).alias("slot"))


def write_shards(docs: DataFrame, path: str, k: int = 8, tasks_per_shard: int = 16, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write `docs` with its shard under path/shard=N, each shard by several tasks; a column
    named shard is replaced. Nothing is joined: a row's shard follows from the cuts."""
    text = F.col(text_col).cast("string")
    group = F.shiftrightunsigned(F.xxhash64(text), 64 - WIDTH)
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    cuts, _ = cut_points(durable(docs.groupBy(group.alias("g")).agg(F.sum(size).alias("bytes"))), k)
    out = docs.withColumn("shard", _number(group, cuts))
    out.repartition(k * tasks_per_shard, "shard", F.pmod(F.xxhash64(id_col), F.lit(tasks_per_shard))).write.partitionBy("shard").parquet(path)


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
