"""As-of replay: every step sees what was known at its instant, in one pass.

A fact belongs to the first step that can see it; what a step sees is the running sum over
the steps up to it. Steps are periods, few by construction (refused beyond MOST)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST = 10_000


def instants(steps: DataFrame, now: str) -> list:
    rows = [r[0] for r in steps.select(now).distinct().orderBy(now).limit(MOST + 1).collect()]
    if len(rows) > MOST:
        raise ValueError(f"over {MOST} steps")
    return rows


def first_step(time: Column, at: list) -> Column:
    """Number (from 0) of the first step that sees `time`; NULL past the last or for NULL."""
    after = F.array(*map(F.lit, at)) if at else F.array().cast("array<timestamp>")
    n = F.size(F.filter(after, lambda s: s < time))
    return F.when(time.isNotNull() & (n < len(at)), n)


def replay(steps: DataFrame, now: str, facts: dict[str, tuple[DataFrame, str, list[Column]]]) -> DataFrame:
    """One row a step: `step`, `now`, and for each (frame, time column, [sum(..).alias ..]) the
    totals of the rows known by then. Rows without a time are never known."""
    at = instants(steps, now)
    out = steps.select(F.col(now).alias("now")).distinct().withColumn("step", F.row_number().over(Window.orderBy("now")) - 1)  # one row a step
    for df, time, sums in facts.values():
        per = df.withColumn("step", first_step(F.col(time), at)).where("step is not null").groupBy("step").agg(*sums)
        names = [c for c in per.columns if c != "step"]
        upto = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # one row a step
        out = out.join(F.broadcast(per), "step", "left").withColumns({c: F.coalesce(F.sum(c).over(upto), F.lit(0)) for c in names})
    return out


def future_knowledge(findings: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Findings (finding_id, now, snapshot_id, baseline_id, created_at) that name a snapshot
    (snapshot_id, committed_at) not committed by `now`, or are dated after it; with the reason.

    A finding without one of the ids is sent to the other, whose time isn't used: all the NULLs
    (most findings have no baseline) would else meet in one task."""
    known = snapshots.groupBy(F.col("snapshot_id").alias("__id")).agg(F.min("committed_at").alias("__at"))
    f = findings.join(known, F.coalesce("snapshot_id", "baseline_id") == F.col("__id"), "left")
    base = known.select(F.col("__id").alias("__other"), F.col("__at").alias("__base"))
    f = f.join(base, F.coalesce("baseline_id", "snapshot_id") == F.col("__other"), "left")
    unseen = lambda c: F.col(c).isNull() | (F.col(c) > F.col("now"))
    why = F.when(F.col("snapshot_id").isNull() | unseen("__at"), "SNAPSHOT").when(F.col("baseline_id").isNotNull() & unseen("__base"), "BASELINE").when(F.col("created_at") > F.col("now"), "CREATED")
    return f.withColumn("reason", why).where("reason is not null").select(*findings.columns, "reason")
