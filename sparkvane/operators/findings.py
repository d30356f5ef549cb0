"""Finding management: FDR, signatures, dedup, ranking, lifecycle, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import half_life
from .series import cumulative

BLOCK = 1 << 16


def benjamini_hochberg(df: DataFrame, p: str, ident: str, family: int | None = None, level: float = 0.10) -> DataFrame:
    """Step-up q values with a family of at least the tests seen; NULL p gives NULL q.

    Equal p share a q (that of their last rank), whatever their `ident`: so ranks and least
    values are of distinct p, and many equal ones (p = 1) are one row. Ranks come from ranges of
    p (`cumulative`), the least value from a rank on from blocks of BLOCK ranks and the blocks
    after them, so no task holds the whole family. Frames run from the last rank down: Spark
    goes through one that ends at UNBOUNDED FOLLOWING again for each row."""
    num = F.col(p).cast("double")
    tests = df.where(F.col(p).isNotNull()).withColumn("__p", F.when(F.isnan(num), float("inf")).otherwise(num))
    size = tests.agg(F.greatest(F.count(F.lit(1)), F.lit(family or 0)).alias("__m"))
    d = cumulative(tests.groupBy("__p").agg(F.count(F.lit(1)).alias("__n")), "__p", "__n").crossJoin(F.broadcast(size))
    d = d.select("__p", "cum", F.floor((F.col("cum") - 1) / BLOCK).alias("__b"), F.least(F.lit(1.0), F.col("__p") * F.col("__m") / F.col("cum")).alias("__q"))
    later = Window.orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    off = d.groupBy("__b").agg(F.min("__q").alias("__l")).select("__b", F.min("__l").over(later).alias("__l"))
    inside = F.min("__q").over(Window.partitionBy("__b").orderBy(F.desc("cum")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = d.withColumn("__i", inside).join(off, "__b").select("__p", F.least("__i", "__l").alias("q"))
    d = tests.join(d, "__p").select(*df.columns, "q")
    d = d.unionByName(df.where(F.col(p).isNull()).withColumn("q", F.lit(None).cast("double")))
    return d.withColumn("rejected", F.coalesce(F.col("q") <= level, F.lit(False)))


def direction(effects: Column) -> Column:
    """UP, DOWN, MIXED or FLAT of an array of effects."""
    up, down = F.exists(effects, lambda e: e > 0), F.exists(effects, lambda e: e < 0)
    return F.when(up & down, "MIXED").when(up, "UP").when(down, "DOWN").otherwise("FLAT")


def signature(*cols) -> Column:
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols)), 256)


def dedupe(findings: DataFrame, sig: str, q: str, score: str, seen: str) -> DataFrame:
    """One pattern per signature: least q, best score, first and latest sight, support."""
    return findings.groupBy(sig).agg(F.min(q).alias("q"), F.max(score).alias("score"), F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"), F.count(F.lit(1)).alias("support"))


def ingest(store: DataFrame, fresh: DataFrame, sig: str, now) -> DataFrame:
    """Upsert of deduped findings into patterns (sig, q, score, first_seen, last_seen, support,
    state, idle): create, extend (closed ones reopen), or age the untouched."""
    a = store.select(*(F.col(c).alias(f"o_{c}") if c != sig else F.col(c) for c in store.columns))
    b = fresh.select(*(F.col(c).alias(f"n_{c}") if c != sig else F.col(c) for c in fresh.columns))
    j = a.join(b, sig, "full")
    is_new, hit = F.col("o_state").isNull(), F.col("n_support").isNotNull()
    state = F.when(is_new, "NEW").when(hit & F.col("o_state").isin("EXPIRED", "RESOLVED"), "REOPENED").otherwise(F.col("o_state"))
    return j.select(
        sig, F.least("o_q", "n_q").alias("q"), F.greatest("o_score", "n_score").alias("score"), F.least("o_first_seen", "n_first_seen").alias("first_seen"), F.greatest("o_last_seen", "n_last_seen").alias("last_seen"),
        (F.coalesce("o_support", F.lit(0)) + F.coalesce("n_support", F.lit(0))).alias("support"), state.alias("state"), F.when(hit, 0).otherwise(F.col("o_idle") + 1).alias("idle"),
    )


def expire_stale(store: DataFrame, windows: int = 3) -> DataFrame:
    return store.withColumn("state", F.when((F.col("idle") >= windows) & F.col("state").isin(*OPEN), "EXPIRED").otherwise(F.col("state")))


OPEN = ("NEW", "REOPENED", "VALIDATED", "CONFIRMED")
TRANSITIONS = {
    "NEW": ("VALIDATED", "REJECTED", "EXPIRED", "EXPLAINED"), "VALIDATED": ("CONFIRMED", "REJECTED", "EXPIRED", "EXPLAINED"), "CONFIRMED": ("RESOLVED", "EXPIRED"),
    "REOPENED": ("VALIDATED", "REJECTED", "EXPIRED", "EXPLAINED"), "EXPLAINED": ("REOPENED",), "EXPIRED": ("REOPENED",), "REJECTED": (), "RESOLVED": ("REOPENED",),
}
NEEDS_EVIDENCE = ("CONFIRMED", "REJECTED", "RESOLVED")


def check_transitions(moves: DataFrame) -> DataFrame:
    """moves: old, new, evidence (count). Adds `verdict`: ok, illegal or no_evidence."""
    legal = F.array(*(F.lit(f"{a}>{b}") for a, bs in TRANSITIONS.items() for b in bs))
    ok = F.array_contains(legal, F.concat_ws(">", "old", "new"))
    return moves.withColumn("verdict", F.when(~ok, "illegal").when(F.col("new").isin(*NEEDS_EVIDENCE) & (F.coalesce("evidence", F.lit(0)) == 0), "no_evidence").otherwise("ok"))


def strength(q) -> Column:
    return F.coalesce(F.greatest(F.lit(0.01), 1 - F.col(q)), F.lit(0.01))


def feedback_prior(confirmed, rejected) -> Column:
    return (F.col(confirmed) + 1) / (F.col(confirmed) + F.col(rejected) + 2)


def rank_queue(patterns: DataFrame, mode: str, capacity: int, ident: str = "pattern_id") -> DataFrame:
    """Operational or discovery queue: score, eligibility, then the first `capacity`.

    patterns: q, age_days, group_size, confirmed, rejected, explained, validated, suppressed, state."""
    damp = F.when(F.col("explained"), 0.05).otherwise(1.0)
    if mode == "operational":
        s = strength("q") * half_life(F.col("age_days"), 3.0) * feedback_prior("confirmed", "rejected") * damp
        ok = F.col("validated")
    else:
        s = 1 / F.col("group_size") * F.sqrt(strength("q")) * feedback_prior("confirmed", "rejected") * damp * F.when(F.col("validated"), 1.0).otherwise(0.25)
        ok = F.lit(True)
    p = patterns.where(ok & ~F.col("suppressed") & F.col("state").isin(*OPEN)).withColumn("queue_score", s)
    top = p.orderBy(F.desc("queue_score"), ident).limit(capacity)  # top-k per partition first
    return top.withColumn("position", F.row_number().over(Window.orderBy(F.desc("queue_score"), ident)))


def suppress(patterns: DataFrame, rules: DataFrame, sig: str) -> DataFrame:
    return patterns.join(rules.select(sig).distinct(), sig, "left_anti")


def link_ancestors(patterns: DataFrame, shape: str, ident: str, at: str) -> DataFrame:
    """Latest earlier pattern of the same shape."""
    w = Window.partitionBy(shape).orderBy(at, ident)
    return patterns.withColumn("ancestor", F.lag(ident).over(w))


def reconcile_holdout(found: DataFrame, held: DataFrame, sig: str) -> DataFrame:
    h = held.select(sig, F.lit(True).alias("__h")).distinct()
    return found.join(h, sig, "left").withColumn("replicated", F.coalesce("__h", F.lit(False))).drop("__h")


def reproduces(a: DataFrame, b: DataFrame) -> bool:
    """Equal as multisets of rows."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def hash_chain_breaks(ledger: DataFrame, seq: str, prev: str, own: str, payload: str, by: list[str] = ()) -> DataFrame:
    """Rows whose link or own hash does not hold, checked pairwise and not serially."""
    before = F.lag(own).over(Window.partitionBy(*by).orderBy(seq))
    d = ledger.withColumn("__before", F.coalesce(before, F.lit("")))
    good = (F.coalesce(prev, F.lit("")) == F.col("__before")) & (F.col(own) == F.sha2(F.concat_ws("|", F.coalesce(prev, F.lit("")), F.col(payload)), 256))
    return d.where(~good).drop("__before")


def structure_stats(feedback: DataFrame, structure: str, confirmed: str, rejected: str) -> DataFrame:
    """Confirmations, rejections and size of each structure group."""
    return feedback.groupBy(structure).agg(F.sum(confirmed).alias("confirmed"), F.sum(rejected).alias("rejected"), F.count(F.lit(1)).alias("group_size"))


def ledger_entries(ledger: DataFrame, actor=None, subject=None, since=None, until=None, limit: int = 100) -> DataFrame:
    """Ledger rows by actor, subject and time, newest first."""
    d = ledger
    for c, v in (("actor", actor), ("subject", subject)):
        d = d.where(F.col(c) == v) if v is not None else d
    d = d.where(F.col("at") >= since) if since is not None else d
    d = d.where(F.col("at") < until) if until is not None else d
    return d.orderBy(F.desc("at"), F.desc("seq")).limit(limit)


def promotions(registry: DataFrame, model: str) -> DataFrame:
    """Promotion history of a model with the stage before each step."""
    w = Window.partitionBy("model").orderBy("at", "seq")
    return registry.where(F.col("model") == model).withColumn("from_stage", F.lag("stage").over(w))


def compare_bundles(now: DataFrame, then: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Current against baseline states of the same probes, with the log ratio."""
    a, b = now.select(*keys, F.col(value).alias("current")), then.select(*keys, F.col(value).alias("baseline"))
    j = a.join(b, keys, "full")
    return j.withColumn("log_ratio", F.when((F.col("current") > 0) & (F.col("baseline") > 0), F.ln(F.col("current") / F.col("baseline"))))
