"""Probes: declarative questions, planned into one aggregate or refused with a reason."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates as A
from .segment import Segment, column_key, canonical_json

KINDS = ("ROW_COUNT", "NULL_RATE", "DISTINCT_COUNT", "QUANTILES", "HEAVY_HITTERS", "CATEGORY_HISTOGRAM", "GRAPH_DEGREE", "COLUMN_BOUNDS", "FRESHNESS", "SEGMENT_AGGREGATE", "JOIN_CARDINALITY")
_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


@dataclass(frozen=True)
class Budget:
    """Ceilings in five currencies; None has none. Composition takes the lesser of each."""

    bytes: float | None = None
    rows: float | None = None
    seconds: float | None = None
    queries: float | None = None
    money: float | None = None

    def compose(self, other: Budget) -> Budget:
        least = lambda a, b: b if a is None else a if b is None else min(a, b)
        return Budget(*(least(getattr(self, f), getattr(other, f)) for f in ("bytes", "rows", "seconds", "queries", "money")))

    def affords(self, **spend: float) -> bool:
        return all(getattr(self, k) is None or v <= getattr(self, k) for k, v in spend.items())

    def after(self, **spend: float) -> Budget:
        return Budget(**{f: None if (v := getattr(self, f)) is None else v - spend.get(f, 0) for f in ("bytes", "rows", "seconds", "queries", "money")})


@dataclass(frozen=True)
class Probe:
    kind: str
    columns: tuple[str, ...] = ()
    segment: Segment = field(default_factory=Segment)
    params: tuple[tuple[str, object], ...] = ()
    budget: Budget = field(default_factory=Budget)

    @property
    def key(self) -> str:
        """Identity without snapshot and budget."""
        body = [self.kind, sorted(map(column_key, self.columns)) if self.kind != "GRAPH_DEGREE" else [column_key(c) for c in self.columns], self.segment.canonical(), sorted([k, str(v)] for k, v in self.params)]
        return "probe_" + hashlib.blake2b(canonical_json(body).encode(), digest_size=16).hexdigest()


class Refusal(Exception):
    """A question that is not answered; the reason is the outcome."""


def plan(probe: Probe, df: DataFrame, blind: frozenset[str] = frozenset(), opaque: frozenset[str] = frozenset(), estimate_bytes: float = 0) -> DataFrame:
    """The probe as a DataFrame over `df`, or Refusal."""
    names = {column_key(c): c for c in df.columns}
    if probe.kind not in KINDS:
        raise Refusal("UNKNOWN_KIND")
    try:
        cols = [names[column_key(c)] for c in probe.columns]
        used = {names[column_key(p.column)] for p in probe.segment.predicates}
    except KeyError as e:
        raise Refusal(f"UNKNOWN_COLUMN {e}") from None
    if blind & (set(cols) | used):
        raise Refusal("BLIND_COLUMN")
    if opaque & set(cols) and probe.kind in ("QUANTILES", "COLUMN_BOUNDS", "FRESHNESS"):
        raise Refusal("OPAQUE_COLUMN")
    if not probe.budget.affords(bytes=estimate_bytes):
        raise Refusal("OVER_BUDGET")
    need = {"ROW_COUNT": 0, "GRAPH_DEGREE": 2, "NULL_RATE": None, "SEGMENT_AGGREGATE": None, "JOIN_CARDINALITY": 1}.get(probe.kind, 1)
    if need is not None and len(cols) != need or need is None and not cols:
        raise Refusal("WRONG_ARITY")
    kinds = {c: df.schema[c].dataType.simpleString() for c in cols}
    if any(k.startswith(("struct", "array", "map", "void")) for k in kinds.values()):
        raise Refusal("UNSUPPORTED_TYPE")
    p = dict(probe.params)
    d = probe.segment.apply(df)
    c = cols[0] if cols else None
    match probe.kind:
        case "ROW_COUNT":
            return d.agg(F.count(F.lit(1)).alias("rows"))
        case "NULL_RATE":
            return A.null_rate(d, cols)
        case "DISTINCT_COUNT":
            return d.agg((F.approx_count_distinct(c) if p.get("approx") else F.count_distinct(c)).alias("distinct"))
        case "QUANTILES":
            if kinds[c] not in _NUMERIC and not kinds[c].startswith("decimal"):
                raise Refusal("NOT_NUMERIC")
            return A.quantiles(d, c, list(p.get("fractions", (0.01, 0.25, 0.5, 0.75, 0.99))))
        case "HEAVY_HITTERS":
            return A.top_k(d, c, int(p.get("k", 50)))
        case "CATEGORY_HISTOGRAM":
            return A.category_histogram(d, c)
        case "GRAPH_DEGREE":
            return A.graph_shape(d, *cols)
        case "COLUMN_BOUNDS":
            return d.agg(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count(c).alias("n"))
        case "FRESHNESS":
            return d.agg(F.max(c).alias("latest"), F.count(c).alias("n"))
        case "SEGMENT_AGGREGATE":
            return d.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"), *(A.moment_columns(p["measure"])[1:4] if "measure" in p else ()))
    return join_cardinality(d, p["other"], c, p["other_column"])


def join_cardinality(left: DataFrame, right: DataFrame, lk: str, rk: str) -> DataFrame:
    """Joined rows, unmatched left rows and the largest fan-out, from key counts only."""
    a = left.groupBy(F.col(lk).alias("k")).agg(F.count(F.lit(1)).alias("l"))
    b = right.where(F.col(rk).isNotNull()).groupBy(F.col(rk).alias("k")).agg(F.count(F.lit(1)).alias("r"))
    j = a.join(b, "k", "left")
    return j.agg(F.sum(F.col("l") * F.coalesce("r", F.lit(0))).alias("joined"), F.sum(F.when(F.col("r").isNull(), F.col("l")).otherwise(0)).alias("unmatched"), F.max("r").alias("max_fan_out"))


def join_edges(profile: DataFrame) -> DataFrame:
    """Join candidates among catalog columns (table, column, type, ndv, lo, hi): containment of
    bounds 0.5, distinct counts 0.3, name affinity 0.2; from 0.5 on. A catalog has one row a column."""
    l = profile.select(*(F.col(c).alias(f"l_{c}") for c in profile.columns))
    r = profile.select(*(F.col(c).alias(f"r_{c}") for c in profile.columns))
    stem = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), "^[a-z]+_", ""), "(_id|_?key)$", "")
    j = l.join(r, (F.col("l_type") == F.col("r_type")) & (F.col("l_table") != F.col("r_table")) & (F.col("l_ndv") <= F.col("r_ndv")) & (F.col("l_ndv") > 0))
    inside = ((F.col("l_lo") >= F.col("r_lo")) & (F.col("l_hi") <= F.col("r_hi"))).cast("double")
    a, b = F.col("l_column"), F.col("r_column")
    name = F.when(F.lower(a) == F.lower(b), 1.0).when(stem(a) == stem(b), 0.9).when(F.endswith(F.lower(a), F.lower(b)) | F.endswith(F.lower(b), F.lower(a)), 0.6).otherwise(0.0)
    conf = 0.5 * F.coalesce(inside, F.lit(0.0)) + 0.3 * F.least(F.lit(1.0), F.col("r_ndv") / F.col("l_ndv")) + 0.2 * name
    return j.select("l_table", "l_column", "r_table", "r_column", F.round(conf, 6).alias("confidence")).where("confidence >= 0.5")
