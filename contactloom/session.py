"""Session and table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def get_session(name: str = "contactloom", **conf: str) -> SparkSession:
    """A session with UTC times and adaptive execution; a cluster's own settings win."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
