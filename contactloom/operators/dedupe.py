"""Duplicates, set operations and partitions of address lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Digits and superscript digits.
DIGIT = "[0-9⁰¹²³⁴⁵⁶⁷⁸⁹]"


def first_original(df: DataFrame, key: Column, pos: str = "pos", email: str = "email") -> DataFrame:
    """The first original of each key.  An aggregate, so a hot key is combined before the shuffle."""
    return df.groupBy(key.alias("key")).agg(F.min(F.struct(F.col(pos), F.col(email))).alias("f")).select("key", F.col(f"f.{email}").alias(email), F.col(f"f.{pos}").alias(pos))


def variant_map(df: DataFrame, key: Column, email: str = "email") -> DataFrame:
    """The variants of each key, sorted."""
    return df.groupBy(key.alias("key")).agg(F.array_join(F.array_sort(F.collect_set(F.lower(F.trim(F.col(email))))), ",").alias("variants"), F.count_distinct(F.lower(F.trim(F.col(email)))).alias("n"))


def across_sources(df: DataFrame, key: Column, pos: str = "pos", width: int = 100_000) -> DataFrame:
    """Rows with their rank within the key; rank 1 is unique, others are duplicates of it.

    A key's rows are ranked in stretches of `width` positions, which are counted
    first, so no task holds more of a hot key than one stretch.
    """
    e = df.withColumn("key", key).withColumn("_part", F.floor(F.col(pos) / width))
    parts = e.groupBy("key", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(pos, "source")).alias("_first"))
    w = Window.partitionBy("key").orderBy("_part")
    parts = parts.select(F.col("key").alias("_key"), F.col("_part").alias("_p"), (F.sum("_n").over(w) - F.col("_n")).alias("_before"), F.first("_first").over(w)["source"].alias("first_source"))
    e = e.join(parts, F.col("key").eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p")))
    rank = F.row_number().over(Window.partitionBy("key", "_part").orderBy(pos))
    return e.select(*df.columns, "key", (F.col("_before") + rank).cast("int").alias("rank"), "first_source")


def merge_footnotes(hits: DataFrame, radius: int = 1) -> DataFrame:
    """Without hits that are another one less its first digit, near it in the same document.

    hits: base, page, local, domain, and pre, what stands before the hit.  The
    last visible character before either of the two must be a digit or a
    superscript, too.
    """
    mark = lambda pre: F.coalesce(F.regexp_like(pre, F.lit(f"{DIGIT}\\s*$")), F.lit(False))
    longer = hits.filter(F.regexp_like("local", F.lit(f"^{DIGIT}.+"))).select(
        "base", "domain", F.col("page").alias("long_page"), F.expr("substring(local, 2)").alias("local"), mark(F.col("pre")).alias("marked")
    )
    near = [hits["base"] == longer["base"], hits["domain"] == longer["domain"], hits["local"] == longer["local"], F.abs(hits["page"] - longer["long_page"]) <= radius]
    return hits.join(longer, [*near, longer["marked"] | mark(hits["pre"])], "left_anti")


def repair_singletons(hits: DataFrame) -> DataFrame:
    """A superscript before the hit is no part of the name, if the shorter name isn't there already."""
    sup = F.regexp_like("pre", F.lit("[¹²³]$"))
    first = F.substring("local", 1, 1)
    cut = F.when(sup & (F.translate(F.substring("pre", -1, 1), "¹²³", "123") == first), F.expr("substring(local, 2)"))
    h = hits.withColumn("cut", cut)
    there = hits.select(F.col("local").alias("cut"), "domain", F.lit(True).alias("there")).distinct()
    j = h.join(there, ["cut", "domain"], "left")
    return j.filter("there is null").select("base", "page", "domain", "pre", F.coalesce("cut", "local").alias("local"), F.col("cut").isNotNull().alias("repaired"))


def postprocess(hits: DataFrame, radius: int = 1) -> DataFrame:
    """Hits less footnote variants (D6), repaired (D7), once for each key (D3), with known endings (V17) and no locals of one or two digits.

    hits: base, page, local, domain, pre.  The first of a key is that of the
    least base, page, local and pre.
    """
    from contactloom.functions.keys import gmail_key
    from contactloom.functions.rules import is_valid_domain

    h = repair_singletons(merge_footnotes(hits, radius))
    h = h.withColumn("email", F.concat("local", F.lit("@"), "domain"))
    first = h.groupBy(gmail_key(F.col("email")).alias("key")).agg(F.min(F.struct("base", "page", "local", "pre", "domain", "email", "repaired")).alias("f")).select("f.*")
    return first.filter(is_valid_domain(F.col("domain")) & ~F.regexp_like("local", F.lit("^[0-9]{1,2}$")))


def latest(df: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """The last row of each key; of equal times the later row."""
    rest = [c for c in df.columns if c not in keys]
    s = F.max(F.struct(F.col(ts).alias("_t"), F.col(tie).alias("_p"), *[F.col(c) for c in rest])).alias("l")
    return df.groupBy(*keys).agg(s).select(*keys, *[F.col(f"l.{c}").alias(c) for c in rest])


def added(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """What isn't there yet, once."""
    return new.select(key).distinct().join(old.select(key).distinct(), key, "left_anti")


def differences(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """Rows of either that the other lacks, with the side."""
    a, b = a.distinct(), b.distinct()
    return a.exceptAll(b).withColumn("side", F.lit(left)).unionByName(b.exceptAll(a).withColumn("side", F.lit(right)))


def domain_classes(df: DataFrame, most: int) -> DataFrame:
    """Foreign, suspicious, cooling or ready; a domain over `most` rows cools down.

    The count is joined back, so no domain's rows need meet in one task.
    """
    n = df.groupBy("domain").agg(F.count(F.lit(1)).alias("n_domain"))
    cls = F.when(F.col("foreign"), "foreign").when(F.col("suspicious"), "suspicious").when(F.col("n_domain") > most, "cooldown").otherwise("ready")
    return df.join(n, "domain").withColumn("cls", cls)


def split_foreign(df: DataFrame, foreign: Column) -> tuple[DataFrame, DataFrame]:
    """Local, foreign."""
    return df.filter(~foreign), df.filter(foreign)
