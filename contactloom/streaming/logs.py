"""Streams over append-only logs: idempotence, quotas, reservations, upserts.

Every builder takes a streaming (or batch) DataFrame with an event time; the
watermark is a choice of the caller, as batch reports drop nothing for lateness.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESERVED = "key string, accepted_at timestamp"
STATE = "last timestamp"


def stream_jsonl(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """H1."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def once_per_window(df: DataFrame, keys: list[str], ts: str = "ts", window: str = "24 hours") -> DataFrame:
    """H2, H3, H8: first event of each key within the watermark; the state expires with it."""
    return df.withWatermark(ts, window).dropDuplicatesWithinWatermark(keys)


def tumbling_counts(df: DataFrame, by: str, ts: str = "ts", window: str = "1 minute", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """H7."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return df.withWatermark(ts, late).groupBy(w, by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("window.start").alias("start"), "n")


def sessions(df: DataFrame, by: str, gap: str, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """H11, an extension."""
    return df.withWatermark(ts, late).groupBy(by, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("session_window.start").alias("start"), "n")


def reserve(df: DataFrame, days: int, key: str = "key", ts: str = "ts", late: str = "1 day") -> DataFrame:
    """H4: events accepted in turn, `days` or more after the key's last accepted one.

    The state is one time for each key and times out with the window.  Within a
    trigger events are taken by time; one that comes later than that but is
    older than the last accepted is refused.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        for t in sorted(t for b in batches for t in b[ts]):
            if last is None or (t - pd.Timestamp(last)).total_seconds() >= days * 86400:
                last = t
                out.append((k[0], t))
        if last is not None:
            state.update((pd.Timestamp(last).to_pydatetime(),))
            mark = state.getCurrentWatermarkMs()
            state.setTimeoutTimestamp(max(int(pd.Timestamp(last).timestamp() * 1000) + days * 86_400_000, mark + 1))
        if out:
            yield pd.DataFrame(out, columns=["key", "accepted_at"])

    d = df.select(F.col(key).cast("string").alias("key"), ts).withWatermark(ts, late)
    return d.groupBy("key").applyInPandasWithState(step, RESERVED, STATE, "append", "EventTimeTimeout")


def upsert_latest(df: DataFrame, path: str, checkpoint: str, key: str, ts: str):
    """H5, H6: a table with the latest time of each key; time never goes back.

    Each batch writes the version of its number from the one before, so a batch
    that is run again gives the same table; the last version is the table.  It
    starts on an empty path: a new checkpoint needs a new path, too.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy(key).agg(F.max(ts).alias(ts))
        if epoch:
            new = new.unionByName(spark.read.parquet(f"{path}/v={epoch - 1}").select(key, ts)).groupBy(key).agg(F.max(ts).alias(ts))
        new.write.mode("overwrite").parquet(f"{path}/v={epoch}")

    return df.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def due_retries(df: DataFrame, now: str, key: str = "email") -> DataFrame:
    """H9: soft bounces whose time has come, retries are left and no success followed."""
    s = df.groupBy(key).agg(
        F.max(F.when(F.col("status") == "success", F.col("ts"))).alias("ok"), F.max(F.when(F.col("status") == "soft", F.struct("ts", "next_retry_at", "retry_count", "max_retries"))).alias("b")
    )
    d = s.filter("b is not null and (ok is null or ok < b.ts)")
    return d.filter((F.col("b.next_retry_at") <= F.lit(now).cast("timestamp")) & (F.col("b.retry_count") < F.col("b.max_retries"))).select(key, F.col("b.next_retry_at").alias("next_retry_at"))
