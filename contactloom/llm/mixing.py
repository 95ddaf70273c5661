"""Mixing sources to target weights, with SQL expressions only.

The words of a source, in a fixed order of its rows, are packed into blocks of
one length.  Each source gets as many slots as its target asks for.  The slots of
all sources are dealt to output shards of equal size by a pseudorandom
permutation: the counts of a shard are a multinomial draw of its sources given
that each source's slots are all used, so the mix meets its targets.  A source's
slots are then numbered through the shards by these counts, and slot k takes the
block at place k of a pseudorandom permutation of the source's block numbers,
again from the start when all are used.  Blocks and slots meet in a join by
number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: A source is used so often at most.
REPEATS = 3
#: Words in a block at most; a source is cut into 256 blocks at least, if it has the words.
BLOCK, BLOCKS = 512, 256
#: Slots of an output shard, and of the rows that make them.
SHARD = 4096
#: Rows of a part for which running sums are made, on average.
PART = 2000
ROUNDS = 24
WORD = r"[^\x20\x09-\x0D]+"


def permuted(x: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """Place of x under a pseudorandom permutation of 0..n-1 (swap or not, per round)."""

    def step(at, r):
        other = F.pmod(F.pmod(F.xxhash64(r, key, F.lit("k")), n) - at, n)
        swap = F.pmod(F.xxhash64(r, key, F.greatest(at, other)), F.lit(2)) == 1
        return F.when(swap, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x.cast("long"), step)


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, row: list[Column]) -> DataFrame:
    """(doc_id, source, skey, hash, row, nth, size) of each row; equal ones are told apart by a number."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(text).alias("hash"),
        (F.array(*row) if row else F.lit(None).cast("array<bigint>")).alias("row"),
    )
    d = d.groupBy("doc_id", "source", "size", "hash", "row").agg(F.count(F.lit(1)).alias("n"))
    d = d.withColumn("skey", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("z")))
    return d.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n")


def source_targets(sized: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """One row for each source: size, weight, target, block length and counts.

    Targets share the total by weight; what a source can't give (its target
    stops at `repeats` times its size) is shared again by weight among the rest.
    Sources are in code point order, null last.  The table has a row for each
    source only, so its running sums may meet in one task.
    """
    per = sized.groupBy("skey").agg(F.sum("size").alias("source_size"), F.first("source").alias("source"))
    # 's...' sorts before 'z': null is last
    number = F.row_number().over(Window.orderBy("skey")) - 1
    per = per.withColumn("number", number.cast("long"))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int")))
    per = per.withColumn("most", F.col("source_size").cast("double") * repeats)
    order = Window.orderBy(F.col("most") / F.col("weight"), "number")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy(F.lit(0)))
    level = (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    per = per.withColumns({"level": level, "rank": F.row_number().over(order)})
    # the first source that isn't full sets the level of all that follow
    free = F.when(F.col("most") > F.col("level") * F.col("weight"), F.struct("rank", "level"))
    per = per.withColumn("at", F.min(free).over(Window.partitionBy(F.lit(0))))
    per = per.withColumn("target", F.when(F.col("rank") >= F.col("at.rank"), F.col("weight") * F.col("at.level")).otherwise(F.col("most")))
    length = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.col("source_size") / BLOCKS))).cast("long")
    per = per.withColumn("length", length).withColumn("blocks", F.ceil(F.col("source_size") / F.col("length")).cast("long"))
    slots = F.when(F.col("source_size") > 0, F.least(F.col("blocks") * repeats, F.round(F.col("target") * F.col("blocks") / F.col("source_size")))).otherwise(0)
    return per.withColumn("slots", slots.cast("long")).drop("most", "level", "rank", "at")


def _runs(rows: DataFrame, size: str, tasks: int) -> DataFrame:
    """Each row as runs (low, high) of at most SHARD of its `size` numbers, dealt evenly to a number of tasks."""
    runs = rows.filter(F.col(size) > 0).withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.col(size) - 1, F.lit(SHARD).cast("long"))))
    return runs.withColumn("high", F.least(F.col(size), F.col("low") + SHARD)).repartition(tasks)


def shard_counts(targets: DataFrame, tasks: int, seed: int = 0) -> DataFrame:
    """(skey, shard, count): how many slots of each output shard each source is drawn for.

    Every shard holds SHARD slots, the last one the rest; a source's counts sum
    up to its slots.
    """
    first = F.sum("slots").over(Window.orderBy("number")) - F.col("slots")
    total = F.sum("slots").over(Window.partitionBy(F.lit(0)))
    runs = _runs(targets.withColumns({"first": first, "all_slots": total}), "slots", tasks)
    slot = runs.select("skey", "all_slots", F.explode(F.sequence(F.col("first") + F.col("low"), F.col("first") + F.col("high") - 1)).alias("slot"))
    dealt = permuted(F.col("slot"), F.col("all_slots"), F.lit(f"deal{seed}"))
    return slot.groupBy("skey", F.floor(dealt / SHARD).alias("shard")).agg(F.count(F.lit(1)).alias("count"))


def draws(targets: DataFrame, counts: DataFrame, tasks: int, seed: int = 0) -> DataFrame:
    """(skey, shard, k, block): the slots of each shard, by source, and the blocks that they take."""
    before = F.sum("count").over(Window.partitionBy("skey").orderBy("shard")) - F.col("count")
    placed = counts.withColumn("before", before).join(targets.select("skey", "blocks"), "skey")
    runs = _runs(placed, "count", tasks)
    s = runs.select("skey", "shard", "blocks", F.explode(F.sequence(F.col("before") + F.col("low"), F.col("before") + F.col("high") - 1)).alias("k"))
    return s.select("skey", "shard", "k", permuted(F.col("k") % F.col("blocks"), F.col("blocks"), F.concat(F.lit(f"block{seed}"), "skey")).alias("block"))


def _pieces(sized: DataFrame, targets: DataFrame, rows: int, slots: int, seed: int) -> DataFrame:
    """A row for each row with words and block that it reaches into, with how often the block is drawn."""
    parts, tasks = max(1, -(-rows // PART)), max(1, -(-slots // (2 * SHARD)))
    key = ["doc_id", "hash", "row", "nth"]
    sized = sized.filter("size > 0").withColumn("part", F.pmod(F.xxhash64(*key), F.lit(parts)))
    inside = Window.partitionBy("skey", "part").orderBy(*key)
    placed = sized.withColumns({"run": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"), "ord": F.row_number().over(inside)})
    starts = sized.groupBy("skey", "part").agg(F.sum("size").alias("n"))
    base = F.sum("n").over(Window.partitionBy("skey").orderBy("part")) - F.col("n")
    starts = starts.select("skey", "part", base.alias("base")).join(targets.select("skey", "source_size", "target", "length"), "skey")
    # both tables grow with the input: they meet in a shuffle, at every size
    placed = placed.join(starts.hint("merge"), ["skey", "part"]).withColumn("at", F.col("base") + F.col("run"))
    first, last = F.floor(F.col("at") / F.col("length")), F.floor((F.col("at") + F.col("size") - 1) / F.col("length"))
    placed = placed.withColumn("block", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("block") * F.col("length") - F.col("at"), F.lit(0))
    high = F.least((F.col("block") + 1) * F.col("length") - F.col("at"), F.col("size"))
    placed = placed.withColumns({"low": low, "high": high})
    drawn = draws(targets, shard_counts(targets, tasks, seed), tasks, seed).groupBy("skey", "block").agg(F.count(F.lit(1)).alias("times"))
    return placed.join(drawn.hint("merge"), ["skey", "block"])


def _prepared(docs, id_col, text_col, source_col, weights, repeats, row):
    from contactloom.llm.blocks import checkpoint

    sized = checkpoint(_sized(docs, id_col, text_col, source_col, row))
    # a row for each source
    targets = checkpoint(source_targets(sized, weights, repeats))
    return sized, targets, sized.count(), int(targets.agg(F.sum("slots")).first()[0] or 0)


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, repeats=REPEATS, seed=0) -> DataFrame:
    """How many words of each row the mix takes, repeats counted.

    Returns doc_id, source, size (words), source_size, target (of the source)
    and taken; no row is taken more than `repeats` times its size.  Null texts
    have no words, a null source is a source.  Rows with a null or repeated id
    are rows of their own.  The draw depends on the rows and the seed only.  An
    empty table gives no rows.  Other columns are not read.
    """
    sized, targets, rows, slots = _prepared(docs, id_col, text_col, source_col, weights, repeats, [])
    pieces = _pieces(sized, targets, rows, slots, seed)
    per = pieces.groupBy("skey", "part", "ord").agg(F.first("doc_id").alias("doc_id"), F.first("hash").alias("hash"), F.first("nth").alias("nth"), F.sum((F.col("high") - F.col("low")) * F.col("times")).alias("taken"))
    key = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("skey", "doc_id", "hash", "nth")]
    out = sized.alias("a").join(per.hint("merge").alias("b"), key[0] & key[1] & key[2] & key[3], "left").select("a.*", F.coalesce("b.taken", F.lit(0)).cast("long").alias("taken"))
    return out.join(targets.select("skey", "source_size", "target"), "skey").select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, repeats=REPEATS, seed=0) -> DataFrame:
    """The mix as rows: the drawn blocks' words of each row, once for each time.

    A row comes back with its whole text where all its blocks are drawn, and
    with the words of those that are (white space kept) otherwise; what is drawn
    repeatedly comes as several rows.  n_chars, if there, is counted anew.  Rows
    without words (null, empty) hold nothing to take and are left out.  A row is
    known by all its columns (but those that hold maps): rows with a null or
    repeated id are rows of their own, and rows equal in all columns are drawn
    one by one.  Any column names may occur.
    """
    from contactloom.llm.blocks import fresh

    def holds_map(t) -> bool:
        return "map<" in t.simpleString() or "variant" in t.simpleString()

    own = [F.col(f"`{f.name}`") for f in docs.schema.fields if not holds_map(f.dataType)]
    own = [x for c in own for x in (c, c.isNull())]
    row = [F.xxhash64(*own), F.xxhash64(F.lit(1), *own)]
    sized, targets, rows, slots = _prepared(docs, id_col, text_col, source_col, weights, repeats, row)
    pieces = _pieces(sized, targets, rows, slots, seed)
    one, two, spans, size, cut_ = fresh(docs.columns, "one", "two", "spans", "size", "cut")
    copies = pieces.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    drawn = copies.groupBy("skey", "part", "ord", "copy").agg(F.first("row").alias("row"), F.first("size").alias(size), F.array_sort(F.collect_list(F.struct("low", "high"))).alias(spans))
    drawn = drawn.select(F.col("row")[0].alias(one), F.col("row")[1].alias(two), size, spans)
    left = docs.withColumns({one: row[0], two: row[1]})
    # one of equal rows serves all; they are only looked for where there are some
    if sized.filter("nth > 1").limit(1).count():
        left = left.dropDuplicates([one, two])
    out = left.join(drawn.hint("merge"), [one, two])
    text = F.col(text_col).cast("string")
    whole = F.aggregate(F.col(spans), F.lit(0).cast("long"), lambda a, s: a + s["high"] - s["low"]) == F.col(size)
    words = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    # white space before the first word is a piece of its own
    shift = F.when(F.regexp_like(text, F.lit(r"\A[\x20\x09-\x0D]")), 1).otherwise(0)
    cut = F.array_join(F.flatten(F.transform(F.col(spans), lambda s: F.slice(words, (s["low"] + 1 + shift).cast("int"), (s["high"] - s["low"]).cast("int")))), "")
    out = out.withColumn(cut_, F.when(whole, text).otherwise(cut))
    value = {text_col: F.col(cut_).cast(docs.schema[text_col].dataType)}
    if "n_chars" in docs.columns:
        value["n_chars"] = F.char_length(cut_).cast(docs.schema["n_chars"].dataType)
    return out.select(*[value.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
