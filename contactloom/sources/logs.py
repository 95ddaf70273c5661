"""Scans of delimited and JSON-lines logs, with schemas that drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SENT_LOG = "key string, email string, last_sent_at string, source string, status string"
#: Names that older logs have for today's columns.
ALIASES = {"ts": "last_sent_at", "sent_at": "last_sent_at", "to": "email", "result": "status", "origin": "source"}
STATS = "ts string, email string, `group` string, status string, success boolean, reason string, uuid string, message_id string"
AUDIT = "type string, email string, reason string, outcome string, ts string, timestamp string, label string, path string, pid int, meta map<string,string>"


def parse_time(c: Column, naive_zone: str = "UTC") -> Column:
    """UTC time of ISO text or epoch seconds; naive text is in `naive_zone`; junk is null."""
    text = F.trim(c)
    zoned = F.regexp_like(text, F.lit("(Z|[+-][0-9]{2}:?[0-9]{2})$"))
    epoch = F.try_to_number(F.when(F.regexp_like(text, F.lit("^[0-9]{9,11}$")), text), F.lit("99999999999"))
    known = F.try_to_timestamp(text)
    return F.coalesce(F.timestamp_seconds(epoch), F.when(zoned, known).otherwise(F.to_utc_timestamp(known, naive_zone)))


def first_of(df: DataFrame, *names: str) -> Column:
    """The first of some columns that is there and not null."""
    have = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def read_csv_log(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """A log with a header, any columns; missing ones are null, malformed rows stay permissive."""
    df = spark.read.option("header", True).option("sep", delimiter).option("mode", "PERMISSIVE").csv(path)
    for old, new in ALIASES.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    for f in T.StructType.fromDDL(SENT_LOG).fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast("string"))
    return df


def guess_delimiter(spark: SparkSession, path: str) -> str:
    """The more frequent of ; and , in the first lines."""
    head = "".join(r.value for r in spark.read.text(path).limit(20).collect())[:1024]
    return ";" if head.count(";") > head.count(",") else ","


def read_jsonl(spark: SparkSession, path: str, schema: str = STATS) -> DataFrame:
    """JSON lines; a line that doesn't parse is dropped."""
    # lines are parsed as values, so that any set of columns can be asked for afterwards
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    line = spark.read.text(path).select(F.from_json("value", schema + ", _bad string", options).alias("j"))
    return line.filter("j is not null and j._bad is null").select("j.*").drop("_bad")


def union_logs(*logs: DataFrame) -> DataFrame:
    out = logs[0]
    for x in logs[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def migrate(stats: DataFrame, sent: DataFrame, file_time: Column) -> DataFrame:
    """One history from both logs: (email, group, sent_at), the last row of each key.

    Only successes count; a JSON event without a readable time has the file's,
    a CSV row without one is left out.
    """
    from contactloom.functions.keys import history_key
    from contactloom.functions.values import SUCCESS

    a = stats.filter(F.lower("status").isin(SUCCESS)).select(
        history_key(F.col("email")).alias("email_norm"), F.lower(F.coalesce("group", F.lit(""))).alias("group_key"), F.coalesce(parse_time(F.col("ts")), file_time).alias("sent_at"), F.lit(0).alias("ord")
    )
    b = sent.filter(F.lower("status").isin(SUCCESS)).select(history_key(F.col("email")).alias("email_norm"), F.lower(F.coalesce("source", F.lit(""))).alias("group_key"), parse_time(F.col("last_sent_at")).alias("sent_at"), F.lit(1).alias("ord"))
    both = a.unionByName(b.filter("sent_at is not null"))
    return both.groupBy("email_norm", "group_key", "sent_at").agg(F.max("ord").alias("origin"))


def block_list(spark: SparkSession, path: str) -> DataFrame:
    """Addresses of a text file, one per line."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("email")).filter("email <> '' and not startswith(email, '#')").distinct()
