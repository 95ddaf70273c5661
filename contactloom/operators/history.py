"""Suppression, edits, and rules on the time since the last send."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that a lookup side may have to be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 200_000


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint to broadcast, only where the rows have been counted."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def not_in(df: DataFrame, block: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't blocked."""
    return df.join(block.select(key).distinct(), key, "left_anti")


def blocked_in(df: DataFrame, block: DataFrame, key: str) -> DataFrame:
    return df.join(block.select(key).distinct(), key, "left_semi")


def last_send(history: DataFrame, key: str, ts: str, group: str, tie: str) -> DataFrame:
    """Last time and group of each key, over all groups."""
    return history.groupBy(key).agg(F.max(F.struct(ts, tie, group)).alias("l")).select(key, F.col(f"l.{ts}").alias("last_at"), F.col(f"l.{group}").alias("last_group"))


def last_per_group(history: DataFrame, key: str, ts: str, group: str) -> DataFrame:
    """W2."""
    return history.groupBy(key, group).agg(F.max(ts).alias("last_at"))


def under_window(last: Column, now: Column, days: int, rule: str = "strict") -> Column:
    """Whether a last send still blocks.

    strict: less than `days`; inclusive: at most; grace: less than a day more.
    """
    age = now.cast("timestamp").cast("long") - last.cast("timestamp").cast("long")
    limit = days * 86400
    test = {"strict": age < limit, "inclusive": age <= limit, "grace": age < limit + 86400}[rule]
    return F.coalesce(test, F.lit(False))


def days_left(last: Column, now: Column, days: int) -> Column:
    """W3."""
    age = F.floor((now.cast("timestamp").cast("long") - last.cast("timestamp").cast("long")) / 86400)
    return F.when(last.isNull(), 0).otherwise(F.greatest(F.lit(0), days - age)).cast("long")


def remaining_text(last: Column, now: Column, days: int) -> Column:
    """Time until the window ends, as days, hours and minutes."""
    left = F.greatest(F.lit(0), last.cast("timestamp").cast("long") + days * 86400 - now.cast("timestamp").cast("long"))
    part = lambda x: F.floor(x).cast("string")
    return F.concat(part(left / 86400), F.lit("d "), part(F.pmod(left, F.lit(86400)) / 3600), F.lit("h "), part(F.pmod(left, F.lit(3600)) / 60), F.lit("m"))


def asof(events: DataFrame, facts: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Each event with the last fact of its key before or at its time.

    One union and one window: both sides are sorted once, no range join.
    """
    e = events.withColumns({"_v": F.lit(None).cast("timestamp"), "_e": F.lit(1)})
    f = facts.select(key, ts, F.col(value).alias("_v"), F.lit(0).alias("_e"))
    w = Window.partitionBy(key).orderBy(ts, "_e").rowsBetween(Window.unboundedPreceding, 0)
    return e.unionByName(f, allowMissingColumns=True).withColumn("matched", F.last("_v", ignorenulls=True).over(w)).filter("_e = 1").drop("_v", "_e")


def gaps(history: DataFrame, key: str, ts: str, tie: str, days: int) -> DataFrame:
    """Time since the key's previous row, and whether that is within `days`."""
    prev = F.lag(ts).over(Window.partitionBy(key).orderBy(ts, tie))
    seconds = F.col(ts).cast("timestamp").cast("long") - prev.cast("timestamp").cast("long")
    return history.withColumn("gap_days", F.floor(seconds / 86400).cast("long")).withColumn("violates", F.coalesce(seconds < days * 86400, F.lit(False)))


def reserve(history: DataFrame, key: str, ts: str, days: int) -> DataFrame:
    """Rows that are accepted in turn, `days` or more after the last accepted one.

    A fold over each key's sorted times; only the times of a key are gathered.
    """
    t = F.transform(F.array_sort(F.collect_list(F.col(ts).cast("timestamp").cast("long"))), lambda x: x)
    start = F.struct(F.lit(None).cast("bigint").alias("last"), F.array().cast("array<bigint>").alias("kept"))
    step = lambda a, x: F.when(a["last"].isNull() | (x - a["last"] >= days * 86400), F.struct(x.alias("last"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a)
    kept = history.groupBy(key).agg(t.alias("t")).withColumn("kept", F.aggregate("t", start, step)["kept"])
    return kept.select(key, F.explode("kept").alias("s")).select(key, F.timestamp_seconds("s").alias("accepted_at"))


def apply_edits(recipients: DataFrame, edits: DataFrame, key: str = "key") -> DataFrame:
    """The last rule of each key replaces or drops; edits: key, pos, new_email (null drops)."""
    rule = edits.groupBy(key).agg(F.max(F.struct("pos", F.col("new_email"))).alias("r")).select(key, F.lit(True).alias("ruled"), F.col("r.new_email").alias("new_email"))
    j = recipients.join(rule, key, "left")
    return j.filter("ruled is null or new_email is not null").withColumn("email", F.coalesce("new_email", "email")).drop("ruled", "new_email")


def provenance(df: DataFrame, primary: DataFrame, fallback: DataFrame, key: str, default: str = "unknown") -> DataFrame:
    """Sources of each key, from the fallback where the first has none."""
    every = lambda d, name: d.groupBy(key).agg(F.array_sort(F.collect_set("source")).alias(name))
    j = df.join(every(primary, "_a"), key, "left").join(every(fallback, "_b"), key, "left")
    return j.withColumn("sources", F.coalesce(F.array_join("_a", ", "), F.array_join("_b", ", "), F.lit(default))).drop("_a", "_b")


def upsert_greatest(old: DataFrame, new: DataFrame, key: str, ts: str) -> DataFrame:
    """H6: one row for each key; time never goes back."""
    return old.select(key, ts).unionByName(new.select(key, ts)).groupBy(key).agg(F.max(ts).alias(ts))


def prepare(recipients: DataFrame, blocked: DataFrame, suppressed: DataFrame, last: DataFrame, now: Column, days: int) -> DataFrame:
    """Recipients with their decision: sanitised, blocked, suppressed, cooling, foreign or ready."""
    from contactloom.functions import keys as K
    from contactloom.functions import rules as R

    base = recipients.withColumns({"email": K.transport_address(F.col("email")), "key": K.history_key(F.col("email"))})
    b = blocked.select("key", F.lit(True).alias("_blocked")).distinct()
    s = suppressed.select("key", F.lit(True).alias("_suppressed")).distinct()
    j = base.join(b, "key", "left").join(s, "key", "left").join(last.select("key", "last_at"), "key", "left")
    cooling = under_window(F.col("last_at"), now, days, "grace")
    cls = (
        F.when(R.strict_reason(F.col("email")).isNotNull(), "invalid")
        .when(F.col("_blocked"), "blocked")
        .when(F.col("_suppressed"), "suppressed")
        .when(R.is_foreign_address(F.col("email")), "foreign")
        .when(cooling, "cooldown")
        .otherwise("ready")
    )
    return j.withColumns({"decision": cls, "days_left": days_left(F.col("last_at"), now, days)}).drop("_blocked", "_suppressed")
