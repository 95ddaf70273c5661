"""Connected components of an edge table, with joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.llm.blocks import checkpoint

#: Parts that the edges of one node are dealt over.
SALT = 16


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges (u, v) with the least label m of u; a node's edges go to SALT tasks."""
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALT)).cast("int")).join(least.hint("shuffle_hash"), ["u", "salt"])


def _settled(e: DataFrame) -> bool:
    """Whether the edges are stars already: each node has one edge down, or only such that come in."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("out")).union(e.select("v", F.lit(0)))
    per = ends.groupBy("n").agg(F.sum("out").alias("out"), F.min("out").alias("centre"))
    return not per.filter((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("centre") == 0))).limit(1).count()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); component is the least id reached.

    Alternating star contraction: each node links its larger neighbours to the
    least node beside it, then its smaller ones, until all edges are stars.  The
    edge count never grows, and each round ends in a checkpoint.  Edges that aren't
    stars after the last of the rounds are an error.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = checkpoint(e)
    for _ in range(rounds):
        if _settled(e):
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: larger neighbours to the least of the neighbourhood
        large = _with_least(both.filter("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: smaller neighbours, and the node itself, to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(large, least).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        e = checkpoint(small.filter("u <> v").distinct())
    else:
        if not _settled(e):
            raise RuntimeError(f"components still change after {rounds} rounds")
    roots = e.select(F.col("v").alias("u"), "v").distinct()
    return e.union(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))
