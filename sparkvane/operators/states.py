"""Sketch states as values that know what they are: sealed envelopes, and what follows from a sketch's size.

An envelope is magic, version, length of a JSON header (kind and parameters), header, CRC-32
of the state, state. States of other kinds or parameters are refused when they are opened,
not merged into nonsense. All of it is column work in the JVM."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAGIC, VERSION = "SVST", 1
#: a set of at most as many members can be listed by asking it
FEW_MEMBERS = 1024
#: deviation of a KLL bin's mass in units of the rank error, and the mass of a usual bin
BIN_NOISE, BIN_SHARE = 0.2, 0.1


def _header(kind: str, params: dict) -> str:
    return json.dumps({"kind": kind, "params": params}, sort_keys=True, separators=(",", ":"))


def _number(c: Column, width: int = 8) -> Column:
    return F.unhex(F.lpad(F.hex(c.cast("long")), width, "0"))


def seal(state: Column, kind: str, **params) -> Column:
    """Envelope of a state; NULL for NULL."""
    head = _header(kind, params).encode()
    front = bytes(f"{MAGIC}{VERSION:02d}", "ascii") + len(head).to_bytes(4, "big") + head
    return F.concat(F.lit(front), _number(F.crc32(state)), state)


def unseal(sealed: Column, kind: str, **params) -> Column:
    """The state in an envelope of this kind and these parameters; anything else raises."""
    head = _header(kind, params).encode()
    front = bytes(f"{MAGIC}{VERSION:02d}", "ascii") + len(head).to_bytes(4, "big") + head
    state = F.substring(sealed, len(front) + 5, 1 << 30)
    fits = F.substring(sealed, 1, len(front)) == F.lit(front)
    whole = F.substring(sealed, len(front) + 1, 4) == _number(F.crc32(state))
    wrong = F.raise_error(F.lit(f"no state of {head.decode()}")).cast("binary")
    broken = F.raise_error(F.lit("a state is damaged")).cast("binary")
    return F.when(sealed.isNull(), F.lit(None).cast("binary")).when(~fits, wrong).when(~whole, broken).otherwise(state)


def describe(sealed: Column) -> Column:
    """Kind and parameters of an envelope as JSON, NULL for anything else."""
    size = F.conv(F.hex(F.substring(sealed, 7, 4)), 16, 10).cast("int")
    text = sealed.substr(F.lit(11), size).cast("string")
    return F.when(F.substring(sealed, 1, 4) == F.lit(MAGIC.encode()), text)


MERGES = {"theta": lambda c, p: F.theta_union_agg(c, p["lg_k"]), "hll": lambda c, p: F.hll_union_agg(c), "kll": lambda c, p: F.kll_merge_agg_double(c, p["k"])}


def merge_sealed(df: DataFrame, c: str, kind: str, by: list[str] = (), **params) -> DataFrame:
    """Merges envelopes of one kind per group into an envelope `c`."""
    d = df.select(*by, unseal(F.col(c), kind, **params).alias(c))
    return d.groupBy(*by).agg(MERGES[kind](F.col(c), params).alias(c)).withColumn(c, seal(F.col(c), kind, **params))


def is_membership_oracle(estimate: Column, few: int = FEW_MEMBERS) -> Column:
    """Would asking the sketch of so many distinct values list its members?"""
    return estimate <= few


def edge_key(source: Column, target: Column) -> Column:
    """Text of a directed edge; lengths in front, so no two edges share one."""
    size = lambda c: F.char_length(c).cast("string")
    return F.concat(size(source), F.lit(":"), source, F.lit(">"), size(target), F.lit(":"), target)


def effective_n(n: Column, epsilon: Column | float) -> Column:
    """Rows that a test over a quantile sketch of rank error `epsilon` may claim: the error
    of a bin adds its variance to that of sampling."""
    e = epsilon if isinstance(epsilon, Column) else F.lit(float(epsilon))
    noise = F.pow(e * BIN_NOISE, 2) / (BIN_SHARE * (1 - BIN_SHARE))
    return F.when(n > 0, 1 / (1 / n.cast("double") + noise)).otherwise(0.0)
