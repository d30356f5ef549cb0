"""Disclosure control: classification, k-anonymity, redaction, differencing, noise."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X

K, QUANTILE_MIN = 20, 100
RESTRICTIVENESS = ("NONE", "QUASI_IDENTIFIER", "INDIRECT_IDENTIFIER", "SENSITIVE", "DIRECT_IDENTIFIER")
NAME_RULES = [
    (r"(^|_)(ssn|social|passport|nino|tax_id|email|phone|mobile|iban|card|pan)($|_)", "DIRECT_IDENTIFIER"), (r"(^|_)(first|last|full|customer|person)?_?name($|_)", "DIRECT_IDENTIFIER"),
    (r"(^|_)(hiv|health|diagnosis|religion|ethnic|salary|income|acctbal)($|_)", "SENSITIVE"), (r"(^|_)(device|cookie|ip|user|cust|customer)_?(id|key|custkey)?($|_)", "INDIRECT_IDENTIFIER"),
    (r"(^|_)(birth|dob|age|gender|sex|zip|postcode|city|nation|country)", "QUASI_IDENTIFIER"),
]


def name_class(c) -> Column:
    n = F.lower(F.col(c) if isinstance(c, str) else c)
    out = F.when(F.lit(False), "")
    for pattern, kind in NAME_RULES:
        out = out.when(n.rlike(pattern), kind)
    return out.otherwise("NONE")


def most_restrictive(classes: Column) -> Column:
    rank = F.array(*map(F.lit, RESTRICTIVENESS))
    return F.element_at(rank, F.array_max(F.transform(classes, lambda c: F.array_position(rank, c))).cast("int"))


def format_support(df: DataFrame, cols: list[str]) -> DataFrame:
    """Share of non-null values that match each recogniser; one scan for all columns."""
    kinds = list(X.FORMATS)
    a = df.agg(*(F.avg(X.matches_format(F.col(c).cast("string"), k).cast("double")).alias(f"{c}|{k}") for c in cols for k in kinds))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(k).alias("format"), F.coalesce(F.col(f"{c}|{k}"), F.lit(0.0)).alias("support")) for c in cols for k in kinds))
    return a.select(F.inline(rows))


def propose_classes(df: DataFrame, cols: list[str], support: float = 0.8) -> DataFrame:
    """Class per column: the more restrictive of its name's and its values' proposals."""
    direct = ["email", "ssn", "card", "iban", "nino", "nic", "pan", "phone"]
    f = format_support(df, cols).groupBy("column").agg(F.max(F.when(F.col("format").isin(direct), F.col("support"))).alias("best"))
    by_value = F.when(F.col("best") >= support, "DIRECT_IDENTIFIER").otherwise("NONE")
    return f.select("column", most_restrictive(F.array(name_class("column"), by_value)).alias("pii_class"))


def access_mode(pii_class: str, hashed_bits: float, floor: float = 24.0) -> str:
    """OPEN, OPAQUE (keyed hash) or BLIND; a column of too little entropy is never hashed."""
    if pii_class in ("NONE", "QUASI_IDENTIFIER"):
        return "OPEN"
    return "OPAQUE" if hashed_bits >= floor else "BLIND"


def entropy_assessment(df: DataFrame, cols: list[str]) -> DataFrame:
    """log2 of the least plausible value space, never below the distinct count."""
    a = df.agg(F.count(F.lit(1)).alias("rows"), *(F.max(X.format_bits(F.col(c).cast("string"))).alias(f"b_{c}") for c in cols), *(F.count_distinct(c).alias(f"d_{c}") for c in cols))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"b_{c}").alias("format_bits"), F.col(f"d_{c}").alias("ndv")) for c in cols))
    t = a.select("rows", F.inline(rows))
    saturated = F.col("rows") >= 2 * F.col("ndv")
    bits = F.when(saturated, F.least(F.col("format_bits"), F.log2("ndv"))).otherwise(F.col("format_bits"))
    return t.withColumn("bits", F.round(F.greatest(bits, F.log2(F.greatest("ndv", F.lit(1)))), 4)).withColumn("enough", F.col("bits") >= 24)


def suppress_small(df: DataFrame, n: str, values: list[str], k: int = K) -> DataFrame:
    return df.withColumns({v: F.when(F.col(n) >= k, F.col(v)) for v in values}).withColumn("suppressed", F.col(n) < k)


def generalise_to_k(df: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """Counts of the finest groupings with k rows: `cube` once, then every cell whose own
    count holds and that has no finer cell that holds below it on the chosen path
    (keys dropped from the last to the first)."""
    sets = [keys[:i] for i in range(len(keys), -1, -1)]
    g = df.groupingSets(sets, *keys).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))
    return g.where(F.col("n") >= k)


def finest_group(df: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """Per row of the finest keys the number of keys kept until k rows share them, and that count."""
    base = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    levels = [F.sum("n").over(Window.partitionBy(*keys[:i])) for i in range(len(keys), -1, -1)]
    b = base.withColumns({f"__{i}": c for i, c in enumerate(levels)})
    kept, size = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i in range(len(keys), -1, -1):
        kept = F.when(F.col(f"__{i}") >= k, F.lit(len(keys) - i)).otherwise(kept)
        size = F.when(F.col(f"__{i}") >= k, F.col(f"__{i}")).otherwise(size)
    return b.select(*keys, "n", kept.alias("kept"), size.alias("cell"))


def quasi_identifiers(profile: DataFrame, k: int = K, widths=(2, 3)) -> DataFrame:
    """profile: column, ndv, rows (a catalog, one row a column). Combinations whose mean
    cell may fall below k."""
    a = profile.select("column", "ndv", "rows")
    b = a.select(F.col("column").alias("c2"), F.col("ndv").alias("d2"))
    two = a.join(b, F.col("column") < F.col("c2")).select(F.array("column", "c2").alias("columns"), (F.col("ndv") * F.col("d2")).alias("space"), "rows")
    out = two
    if 3 in widths:
        c = a.select(F.col("column").alias("c3"), F.col("ndv").alias("d3"))
        out = two.unionByName(two.join(c, F.element_at("columns", 2) < F.col("c3")).select(F.concat("columns", F.array("c3")).alias("columns"), (F.col("space") * F.col("d3")).alias("space"), "rows"))
    cell = F.col("rows") / F.least("rows", "space")
    return out.select(F.array_join("columns", "+").alias("columns"), cell.alias("mean_cell"), (cell < k).alias("risky"))


def redact(df: DataFrame, actions: dict[str, tuple]) -> DataFrame:
    """actions: column -> (SUPPRESS,), (HASH, key), (BUCKET, width), (GENERALISE, keep) or (ALLOW,)."""
    out = {}
    for c, (what, *arg) in actions.items():
        if what == "SUPPRESS":
            out[c] = F.lit(None).cast(df.schema[c].dataType)
        elif what == "HASH":
            out[c] = X.keyed_hash(c, arg[0])
        elif what == "BUCKET":
            out[c] = X.bucket(c, arg[0])
        elif what == "GENERALISE":
            out[c] = X.generalise_prefix(c, arg[0])
        elif what != "ALLOW":
            raise ValueError(what)
    return df.withColumns(out)


def tokenise(df: DataFrame, c: str, order: str, namespace: str, by: list[str] = ()) -> DataFrame:
    """NAME_<n> by first sight. Numbering runs over the distinct values only."""
    first = df.where(F.col(c).isNotNull()).groupBy(*by, c).agg(F.min(order).alias("__f"))
    n = first.withColumn("token", F.concat(F.lit(f"{namespace}_"), F.row_number().over(Window.partitionBy(*by).orderBy("__f", c)))).drop("__f")
    return df.join(n, [*by, c], "left")


def restore_tokens(df: DataFrame, token: str, mapping: DataFrame) -> DataFrame:
    return df.join(mapping, token, "left")


def differencing_conflicts(releases: DataFrame, k: int = K) -> DataFrame:
    """releases: release_id, scope, predicates (array), n. Nested pairs whose counts differ by
    1..k-1. Pairs meet only inside a scope and on a shared predicate (or the universe)."""
    r = releases.withColumn("size", F.size("predicates"))
    key = F.explode(F.array_union("predicates", F.array(F.lit("")))).alias("key")
    a = r.select("release_id", "scope", "predicates", "n", "size", key)
    b = r.select(F.col("release_id").alias("id2"), F.col("scope").alias("scope2"), F.col("predicates").alias("p2"), F.col("n").alias("n2"), F.col("size").alias("size2"), F.explode(F.when(F.size("predicates") > 0, F.slice("predicates", 1, 1)).otherwise(F.array(F.lit("")))).alias("key2"))
    j = a.join(b, (F.col("scope") == F.col("scope2")) & (F.col("key") == F.col("key2")) & (F.col("size") > F.col("size2")))
    nested = X.is_subset("p2", "predicates")
    gap = F.abs(F.col("n") - F.col("n2"))
    return j.where(nested & (gap > 0) & (gap < k)).select("release_id", F.col("id2").alias("against"), gap.alias("gap")).distinct()


def laplace_count(n, epsilon: float, u) -> Column:
    """Count with Laplace noise from a uniform column."""
    c = u - 0.5
    return n - F.signum(c) * F.ln(1 - 2 * F.abs(c)) / epsilon


def noisy_quantile(values: list[float], q: float, epsilon: float, lo: float, hi: float, u: float, v: float) -> float:
    """Exponential mechanism over the gaps of sorted values (of one released cell)."""
    x = [lo, *sorted(min(hi, max(lo, a)) for a in values), hi]
    w = [(b - a) * math.exp(-epsilon * abs(i - q * len(values)) / 2) for i, (a, b) in enumerate(zip(x, x[1:]))]
    t, acc = u * sum(w), 0.0
    for i, wi in enumerate(w):
        acc += wi
        if acc >= t and wi > 0:
            return x[i] + v * (x[i + 1] - x[i])
    return hi


def backstop(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows and columns in which a direct identifier's format stands anywhere."""
    kinds = ("email", "ssn", "card", "iban")
    hit = [F.when(F.col(c).rlike(X.FORMATS[k]), F.struct(F.lit(c).alias("column"), F.lit(k).alias("format"))) for c in cols for k in kinds]
    return df.select("*", F.explode(F.array_compact(F.array(*hit))).alias("h")).select(*df.columns, "h.column", "h.format")


def governed_view(df: DataFrame, modes: dict[str, str], key: bytes) -> DataFrame:
    """OPEN columns as they are, OPAQUE ones as <name>__opaque keyed hashes, BLIND ones gone.
    Expressions on top of it are pushed through, so a pruned column is never hashed."""
    out = []
    for c in df.columns:
        mode = modes.get(c, "OPEN")
        if mode == "OPEN":
            out.append(F.col(c))
        elif mode == "OPAQUE":
            out.append(X.keyed_hash(c, key).alias(f"{c}__opaque"))
        elif mode != "BLIND":
            raise ValueError(mode)
    return df.select(*out)


def guard_columns(df: DataFrame, blind: set[str]) -> DataFrame:
    """Refuses a plan that mentions a blind column anywhere, and a result that has one."""
    import re

    text = df._jdf.queryExecution().analyzed().toString() if hasattr(df, "_jdf") else ""
    for c in blind:
        if c in df.columns or re.search(rf"\b{re.escape(c)}#", re.sub(r"(?m)^.*(?:Relation|LogicalRDD|LocalRelation).*$", "", text)):
            raise PermissionError(f"column {c} is blind")
    return df


def guardrail(attribute: Column, op: str, value, restrictive: bool = True) -> Column:
    """Predicate that fails closed: a missing attribute gives the restrictive answer."""
    ops = {"eq": lambda a: a == value, "ne": lambda a: a != value, "lt": lambda a: a < value, "le": lambda a: a <= value, "gt": lambda a: a > value, "ge": lambda a: a >= value, "in": lambda a: a.isin(*value), "not_in": lambda a: ~a.isin(*value), "matches": lambda a: a.rlike(value)}
    return F.coalesce(ops[op](attribute), F.lit(restrictive))


def schema_names(df: DataFrame, mode: str, descriptions: dict[str, str] | None = None) -> DataFrame:
    """FULL keeps names, DESCRIBED shows descriptions, OPAQUE numbers the columns."""
    if mode == "FULL":
        return df
    names = [(descriptions or {}).get(c, f"column_{i}") if mode == "DESCRIBED" else f"column_{i}" for i, c in enumerate(df.columns)]
    return df.toDF(*names)


class EgressGate:
    """Order of checks before a released aggregate leaves: names, k, differencing, backstop;
    then the ledger row. The ledger is a DataFrame of (release_id, scope, predicates, n)."""

    def __init__(self, k: int = K) -> None:
        self.k = k

    def check(self, release: DataFrame, ledger: DataFrame, blind: set[str], n: str = "n") -> dict[str, int]:
        guard_columns(release, blind)
        small = release.where(F.col(n) < self.k).count()
        strings = [f.name for f in release.schema if f.dataType.simpleString() == "string"]
        return {"small_cells": small, "differencing": differencing_conflicts(ledger, self.k).count(), "backstop": backstop(release, strings).count() if strings else 0}
