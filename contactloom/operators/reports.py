"""Aggregated reports; addresses don't appear in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_day(ts: Column, day: str, zone: str = "UTC") -> Column:
    """Half-open local day."""
    start = F.to_utc_timestamp(F.lit(day).cast("timestamp"), zone)
    return (ts >= start) & (ts < F.to_utc_timestamp(F.date_add(F.lit(day).cast("date"), 1).cast("timestamp"), zone))


def local_day(ts: Column, zone: str) -> Column:
    """Z6."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def counts(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def top(df: DataFrame, by: str, k: int) -> DataFrame:
    """O2: most frequent first, ties by name."""
    return counts(df, by).orderBy(F.desc("n"), F.asc(by)).limit(k)


def summary(df: DataFrame, *dims: str) -> DataFrame:
    """A1: counts by each dimension in one pass (grouping sets)."""
    one = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims])).alias("x")
    return df.select(one).groupBy("x.dim", "x.value").agg(F.count(F.lit(1)).alias("n"))


def ok_err(df: DataFrame, ok: Column, err: Column, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count_if(ok).alias("ok"), F.count_if(err).alias("err"))


def rolling(df: DataFrame, ts: str, end: str, periods: dict[str, int], ok: Column) -> DataFrame:
    """A5: one row for each period that ends at `end`, in one pass."""
    age = F.lit(end).cast("timestamp").cast("long") - F.col(ts).cast("timestamp").cast("long")
    e = df.withColumn("period", F.explode(F.array(*[F.when((age >= 0) & (age < d * 86400), F.lit(p)) for p, d in periods.items()]))).filter("period is not null")
    return e.groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("ok"))


def zero_filled(df: DataFrame, by: str, values: list[str]) -> DataFrame:
    """A count for each value, 0 where none."""
    every = df.sparkSession.createDataFrame([(v,) for v in values], f"{by} string")
    return every.join(counts(df, by), by, "left").select(by, F.coalesce("n", F.lit(0)).alias("n"))


def bounce_counter(df: DataFrame, key: str, ts: str, tie: str, code: str) -> DataFrame:
    """A12."""
    last = F.max(F.struct(ts, tie, code)).alias("l")
    return df.groupBy(key).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count(F.lit(1)).alias("hits"), last).withColumn("last_code", F.col(f"l.{code}")).drop("l")


def worst_or_best(df: DataFrame, key: str, cls: str, score: str) -> DataFrame:
    """A10: a role row of the least score if there is one, else the row of the largest."""
    role = F.col(cls) == "role"
    s = F.min(F.struct(F.when(role, 0).otherwise(1).alias("p"), F.when(role, F.col(score)).otherwise(-F.col(score)).alias("o"), F.col(cls), F.col(score))).alias("b")
    return df.groupBy(key).agg(s).select(key, F.col(f"b.{cls}").alias(cls), F.col(f"b.{score}").alias(score))


def page_window(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """O4."""
    return df.orderBy(*order).offset(offset).limit(limit)


def origin_counts(hits: DataFrame, key: str, origins: list[str]) -> DataFrame:
    """Hits of each key by origin, zero where there are none."""
    return hits.groupBy(key).agg(*[F.count_if(F.col("origin") == o).alias(f"hits_{o}") for o in origins])


def merge_member_stats(members: DataFrame, by: str, progress: tuple[str, ...] = ("files_total", "files_processed", "files_skipped_timeout", "last_file")) -> DataFrame:
    """Statistics of an archive from those of its members: whole numbers are summed, but for those that tell of progress."""
    whole = [f.name for f in members.schema.fields if f.dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") and f.name not in (by, *progress)]
    return members.groupBy(by).agg(*[F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in whole])
