"""Exact duplicates by progressive refinement: length, prefix hash, full hash."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from contactloom.llm import blocks as B

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@F.pandas_udf(StringType())
def full_hash(text: pd.Series) -> pd.Series:
    """SHA-256 of a text with A-Z lower-cased, as UTF-8."""
    return text.map(lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass").lower()).hexdigest())


def prefix_hash(text: Column, length: int = 48) -> Column:
    return F.xxhash64(F.translate(F.substring(text, 1, length), UPPER, LOWER))


def _refined(docs: DataFrame, text_col: str, spread: Column, hash_all: bool, names: list[str]) -> DataFrame:
    """`docs` with length, prefix hash, how many rows share both (null: none other) and the full hash.

    One aggregation counts both levels.  Only rows whose (length, prefix) isn't
    unique are hashed in full, unless `hash_all` asks for every row's hash.
    """
    size, prefix, again, sha = names
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.withColumns({size: F.octet_length(text).cast("long"), prefix: prefix_hash(text)})
    pairs = B.checkpoint(docs.groupBy(size, prefix).agg(F.count(F.lit(1)).alias(again)).filter(F.col(again) > 1))
    docs = B.split_join(docs, pairs, [size, prefix], again, [spread])
    wanted = F.lit(True) if hash_all else F.col(again).isNotNull()
    return docs.withColumn(sha, F.when(wanted, full_hash(F.when(wanted, text).otherwise(F.lit("")))))


def _groups(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, again, sha) with the id that stays and the size of their group, null where there is none."""
    groups = rows.filter("again is not null").groupBy("sha").agg(F.max("doc_id").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return B.checkpoint(groups)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_all: bool = False) -> DataFrame:
    """One row for each row: id, keep_id, group_size, kept, and the text's hash.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    The row with the largest id of a group stays; a null id is the smallest, and
    rows that repeat both id and text stand or fall together.  Other columns are
    not read.  An empty table gives no rows.

    Rows are grouped by length, then by the hash of a prefix; only rows that
    share both with another are read in full and hashed, at every size of the
    table, unless `hash_all` asks for every row's hash (else null).  Keys that
    hold a large share of the rows are joined by a bounded broadcast, the others
    meet in a shuffle.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = _refined(base, "text", F.col("doc_id"), hash_all, ["size", "prefix", "again", "sha"])
    rows = B.checkpoint(rows.select("doc_id", "again", "sha"))
    # what is in no group goes to no one task either
    left = rows.withColumn("own", F.col("sha")).withColumn("sha", F.coalesce(F.when(F.col("again").isNotNull(), F.col("sha")), F.concat(F.lit("-"), F.xxhash64("doc_id").cast("string"))))
    out = B.split_join(left, _groups(rows), ["sha"], "n", [F.col("doc_id")])
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.col("own").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, as they are: of each group of equal texts the one with the largest id.

    The decision is on the row, not on its id: where an id stands on several
    texts each is judged by its own group, and of rows that repeat id and text
    one stays.  Nulls, empty texts and empty tables as for exact_duplicates; any
    column names may occur.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = _refined(base, "text", F.col("doc_id"), False, ["size", "prefix", "again", "sha"])
    rows = B.checkpoint(rows.filter("again is not null").select("doc_id", "sha", B.text_key(F.col("text"))[0].alias("key")))
    # of texts with one id that differ in case one stands for the group
    row = F.struct("doc_id", "key")
    groups = B.checkpoint(rows.groupBy("sha").agg(F.max(row).alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    gone = B.split_join(rows, groups, ["sha"], "n", [F.col("doc_id")]).filter(F.col("n").isNotNull() & ~row.eqNullSafe(F.col("top")))
    own, key, other, hash_ = B.fresh(docs.columns, "own", "key", "other", "hash")
    left = docs.withColumns({own: F.col(id_col).cast("long"), key: B.text_key(F.col(text_col))[0]})
    # rows that repeat id and text were judged alike and go as one; they are only looked for where there are some
    if rows.groupBy("doc_id", "key").count().filter("count > 1").limit(1).count():
        left = left.dropDuplicates([own, key])
    gone = gone.select(F.col("doc_id").alias(other), F.col("key").alias(hash_))
    out = left.join(gone.hint("shuffle_hash"), F.col(own).eqNullSafe(F.col(other)) & (F.col(key) == F.col(hash_)), "left_anti")
    return out.select(*docs.columns)
