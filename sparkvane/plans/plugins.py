"""Extension points: registered sources, sketches, detectors, features and context."""

from __future__ import annotations

from collections.abc import Callable
from importlib.metadata import entry_points

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REGISTRY: dict[str, dict[str, object]] = {k: {} for k in ("source", "sketch", "detector", "feature", "context")}


def _register(kind: str, name: str, version: str, obj):
    if name in REGISTRY[kind]:
        raise ValueError(f"{kind} {name} is registered twice")
    REGISTRY[kind][name] = (version, obj)
    return obj


def source(name: str, version: str = "1.0.0"):
    """A DataSource class."""
    return lambda cls: _register("source", name, version, cls)


def detector(name: str, version: str = "1.0.0"):
    """(series DataFrame, policy) -> findings DataFrame."""
    return lambda f: _register("detector", name, version, f)


def feature(name: str, version: str = "1.0.0"):
    """(columns) -> aggregate Column."""
    return lambda f: _register("feature", name, version, f)


def context(name: str, version: str = "1.0.0"):
    """(spark, start, end) -> events DataFrame."""
    return lambda f: _register("context", name, version, f)


class Sketch:
    """A mergeable summary: identity(), of(values), merge(a, b), encode, decode."""

    def identity(self): ...
    def of(self, values): ...
    def merge(self, a, b): ...
    def encode(self, s) -> bytes: ...
    def decode(self, b: bytes): ...


def check_laws(s: Sketch, samples: list[list]) -> None:
    """Identity, commutativity, associativity and a round trip, on encoded states."""
    e = s.encode
    states = [s.of(x) for x in samples]
    for a in states:
        if e(s.merge(a, s.identity())) != e(a) or e(s.merge(s.identity(), a)) != e(a):
            raise ValueError("no two-sided identity")
        if e(s.decode(e(a))) != e(a):
            raise ValueError("no round trip")
        for b in states:
            if e(s.merge(a, b)) != e(s.merge(b, a)):
                raise ValueError("merge does not commute")
            for c in states:
                if e(s.merge(s.merge(a, b), c)) != e(s.merge(a, s.merge(b, c))):
                    raise ValueError("merge does not associate")


def sketch(name: str, samples: list[list], version: str = "1.0.0"):
    def add(cls):
        check_laws(cls(), samples)
        return _register("sketch", name, version, cls)

    return add


def run_sketch(df: DataFrame, c: str, s: Sketch, by: list[str] = ()) -> DataFrame:
    """Partial states per partition, then merged per group: only states are shuffled."""
    keys = list(by)
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = (kinds + ", " if kinds else "") + "state binary"

    def partial(frames):
        import pandas as pd

        acc: dict[tuple, object] = {}
        for pdf in frames:
            groups = pdf.groupby(keys, dropna=False) if keys else [((), pdf)]
            for k, g in groups:
                acc[k] = s.merge(acc.get(k, s.identity()), s.of(g[c].tolist()))
        yield pd.DataFrame([[*k, s.encode(v)] for k, v in acc.items()], columns=[*keys, "state"])

    def final(pdf):
        import pandas as pd

        st = s.identity()
        for b in pdf["state"]:
            st = s.merge(st, s.decode(bytes(b)))
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), s.encode(st)]], columns=[*keys, "state"])

    parts = df.where(F.col(c).isNotNull()).select(*keys, c).mapInPandas(partial, schema)  # nulls are no items
    return parts.groupBy(*(keys or [F.lit(0).alias("__all")])).applyInPandas(final, schema)


def discover(group: str = "sparkvane.plugins") -> list[str]:
    """Imports installed entry points, which register themselves."""
    return [e.name for e in entry_points(group=group) if e.load() is not None]


def compatible(have: str, want: str) -> bool:
    """Same major version, not older."""
    a, b = ([int(x) for x in v.split(".")] for v in (have, want))
    return a[0] == b[0] and a >= b


def run_detector(name: str, series: DataFrame, policy: Callable | dict) -> DataFrame:
    return REGISTRY["detector"][name][1](series, policy)  # type: ignore[index]
