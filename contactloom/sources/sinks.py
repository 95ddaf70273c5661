"""Writers of logs, previews and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_events(df: DataFrame, path: str, reason_length: int = 300) -> None:
    """K1-K3: JSON lines, appended; reasons are cut."""
    if "reason" in df.columns:
        df = df.withColumn("reason", F.substring("reason", 1, reason_length))
    df.write.mode("append").json(path)


def write_log(df: DataFrame, path: str) -> None:
    """K7: the whole log anew; the commit protocol keeps readers from half a file."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_preview(df: DataFrame, path: str) -> None:
    """K4, K5: one folder for each section."""
    df.write.mode("overwrite").partitionBy("section").option("header", True).csv(path)


def preview_stats(df: DataFrame) -> DataFrame:
    """K6: rows with an address and a reason only."""
    return df.filter("coalesce(email, '') <> '' and coalesce(reason, '') <> ''").select("email", "reason", "section")


def csv_rows(df: DataFrame) -> DataFrame:
    """K8: rows as CSV text."""
    return df.select(F.to_csv(F.struct(*df.columns)).alias("line"))


def archive(df: DataFrame, path: str, day: str) -> None:
    """Closed days, compressed, by day."""
    df.write.mode("append").partitionBy(day).option("compression", "gzip").json(path)
