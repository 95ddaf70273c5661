"""Quotas, islands and delays over ordered events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rate_plan(events: DataFrame, key: str, ts: str, pos: str, limit: int, unit: str = "minute") -> DataFrame:
    """The first `limit` rows of a key in each unit go, others are deferred."""
    w = Window.partitionBy(key, F.date_trunc(unit, F.col(ts))).orderBy(ts, pos)
    return events.withColumn("place", F.row_number().over(w).cast("long")).withColumn("passes", F.col("place") <= limit)


def sliding_count(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Rows of the key in the last `seconds`, this one included.

    Time is cut into stretches of `seconds`; a row counts in its own and is looked
    back at from the next, so no task holds more of a key than two stretches.
    """
    e = events.withColumn("_s", F.col(ts).cast("timestamp").cast("long")).withColumn("_own", F.floor(F.col("_s") / seconds))
    e = e.withColumn("_part", F.explode(F.array("_own", F.col("_own") + 1)))
    w = Window.partitionBy(key, "_part").orderBy("_s").rangeBetween(-(seconds - 1), 0)
    return e.withColumn("n_recent", F.count(F.lit(1)).over(w)).filter(F.col("_part") == F.col("_own")).drop("_s", "_own", "_part")


def runs(events: DataFrame, key: str, order: list[str], flag: Column) -> DataFrame:
    """Length so far of the run of flagged rows, 0 where not flagged."""
    w = Window.partitionBy(key).orderBy(*order)
    e = events.withColumn("_f", flag.cast("int"))
    e = e.withColumn("_island", F.sum(1 - F.col("_f")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(key, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("run", F.sum("_f").over(inside).cast("long")).drop("_f", "_island")


def backoff(run: Column, base: int = 60, most: int = 60) -> Column:
    """Seconds to wait after so many failures in a row."""
    return F.when(run > 0, F.greatest(F.lit(base), F.least(F.pow(F.lit(2.0), run - 1), F.lit(most)))).otherwise(0).cast("long")


def adaptive_delay(events: DataFrame, key: str, order: str, failed: Column, step: float, decay: float, most: float) -> DataFrame:
    """A delay that each failure raises and each success lowers, within 0 and `most`; its last value."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), failed.alias("f"))))
    fold = F.aggregate(rows, F.lit(0.0), lambda a, x: F.greatest(F.lit(0.0), F.least(F.lit(most), a + F.when(x["f"], step).otherwise(-decay))))
    return events.groupBy(key).agg(F.round(fold, 6).alias("delay"))


def last_batch(events: DataFrame, ts: str) -> DataFrame:
    """The rows of the last time."""
    top = events.agg(F.max(ts).alias("_top"))
    return events.join(F.broadcast(top), F.col(ts) == F.col("_top")).drop("_top")


def too_close(events: DataFrame, key: str, ts: str, tie: str, seconds: int) -> DataFrame:
    """Rows less than `seconds` after the key's previous one."""
    gap = F.col(ts).cast("timestamp").cast("long") - F.lag(ts).over(Window.partitionBy(key).orderBy(ts, tie)).cast("timestamp").cast("long")
    return events.withColumn("gap", gap).filter(F.col("gap") < seconds)


def capped(rows: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """The first `most` rows of each key (the limit is the operator)."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")


def page_scan_order(total: int, stride: int) -> list[int]:
    """Every stride-th page first, then the others."""
    first = list(range(0, total, stride))
    return first + [i for i in range(total) if i % stride]


def sampled_scan(pages: DataFrame, doc: str, page: str, new_hits: str, stride: int, patience: int, target: int) -> DataFrame:
    """Pages that a sampled scan reads: it stops after `patience` pages without a hit, or at `target` hits."""
    order = [F.col(page) % stride != 0, F.col(page)]
    w = Window.partitionBy(doc).orderBy(*order)
    p = pages.withColumns({"rank": F.row_number().over(w).cast("long"), "found": F.coalesce(F.sum(new_hits).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    p = p.withColumn("last_hit", F.coalesce(F.max(F.when(F.col(new_hits) > 0, F.col("rank"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return p.filter((F.col("found") < target) & (F.col("rank") - F.col("last_hit") <= patience))


def idempotent(events: DataFrame, key: str, ts: str, tie: str, seconds: int) -> DataFrame:
    """H2: rows without one of their key in the `seconds` before."""
    gap = F.col(ts).cast("timestamp").cast("long") - F.lag(ts).over(Window.partitionBy(key).orderBy(ts, tie)).cast("timestamp").cast("long")
    return events.withColumn("_g", gap).filter(F.col("_g").isNull() | (F.col("_g") >= seconds)).drop("_g")


def chunked(rows: DataFrame, by: str, order: list[str], size: int) -> DataFrame:
    """Number of each row's chunk within `by`."""
    return rows.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1) / size).cast("long"))
