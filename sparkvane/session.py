"""Session construction and table loading."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def build_session(app: str = "sparkvane", master: str | None = None, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution on; `conf` overrides anything."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table. `timestamp_ntz` columns stay as stored (UTC wall time)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def utc(df: DataFrame, *cols: str) -> DataFrame:
    """Cast naive timestamps to UTC instants once, at the scan."""
    return df.withColumns({c: F.col(c).cast("timestamp") for c in cols})
