"""Vectorised text kernels and a compact exchange.

Texts reach Python as Arrow buffers and are handled as flat byte arrays, so no
Python object is made per word or per byte.  What has to meet by key travels as
packed arrays ("blobs"), one row for each map batch and bucket: the shuffle
carries a few bytes an item and a bucket is sorted by numpy, not row by row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of text worked on at a time; longer texts are taken alone.
CHUNK = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    x = x ^ (x >> _U(29))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(32)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(29)
    return x


class Poly:
    """Fingerprints of slices: sums of table[symbol] * base**i, modulo 2**64."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
        base = (_BASE * (2 * seed + 1)) % (1 << 64)
        base = base - base % 8 + 5  # of the largest order
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=_U)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), CHUNK + 4096)
            for name, b in (("up", self.base), ("down", self.inverse)):
                p = np.full(size, b, dtype=_U)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up[:n], self.down[:n]

    def sums(self, values: np.ndarray) -> np.ndarray:
        up, _ = self.powers(len(values) + 1)
        s = np.zeros(len(values) + 1, dtype=_U)
        np.cumsum(values * up[:-1], out=s[1:])
        return s

    def slices(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Fingerprints of [start, end) for arrays of starts and ends."""
        _, down = self.powers(len(sums))
        return mix((sums[end] - sums[start]) * down[start])

    def windows(self, sums: np.ndarray, length: int) -> np.ndarray:
        """Fingerprints of all slices of one length."""
        n = len(sums) - length
        if n <= 0:
            return np.zeros(0, dtype=_U)
        _, down = self.powers(len(sums))
        return mix((sums[length:] - sums[:-length]) * down[:n])


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def chunks(column: pa.Array, size: int = CHUNK):
    """(first row, bytes, offsets) of runs of rows of about `size` bytes."""
    data, at = flat(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        j = min(j, n)
        yield i, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def split_words(data: np.ndarray, at: np.ndarray):
    """Starts and ends of the words, and the place of each row's first word."""
    word = ~SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[at] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, at)


def rows_of(first: np.ndarray) -> np.ndarray:
    """Row of each word, from the places of the rows' first words."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def fits(first: np.ndarray, length: int) -> np.ndarray:
    """Starts of the windows of `length` items that lie within one row."""
    n = int(first[-1])
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    return np.flatnonzero(left >= length)


# ---------------------------------------------------------------- exchange


def _put(kind: str, a: np.ndarray) -> bytes:
    if kind == "doc":  # ids of consecutive rows: differences need few bytes
        d = np.diff(a)
        w = next(w for w in (1, 2, 4, 8) if w == 8 or not len(d) or (d.min() >= -(1 << (8 * w - 1)) and d.max() < 1 << (8 * w - 1)))
        return bytes([w]) + a[:1].astype("<i8").tobytes() + d.astype(f"<i{w}").tobytes()
    if kind == "pos":
        return (a & 0xFFFF).astype("<u2").tobytes() + (a >> 16).astype("<u2").tobytes()
    if kind == "h6":
        return (a >> _U(32)).astype("<u4").tobytes() + ((a >> _U(16)) & _U(0xFFFF)).astype("<u2").tobytes()
    return a.astype(kind).tobytes()


def _get(kind: str, b: memoryview, p: int, n: int) -> tuple[np.ndarray, int]:
    if kind == "doc":
        if not n:
            return np.zeros(0, np.int64), p + 1
        w = b[p]
        a = np.empty(n, np.int64)
        a[0] = np.frombuffer(b, "<i8", 1, p + 1)[0]
        a[1:] = np.frombuffer(b, f"<i{w}", n - 1, p + 9)
        return np.cumsum(a), p + 9 + w * (n - 1)
    if kind == "pos":
        lo, hi = np.frombuffer(b, "<u2", n, p), np.frombuffer(b, "<u2", n, p + 2 * n)
        return lo.astype(np.int64) | (hi.astype(np.int64) << 16), p + 4 * n
    if kind == "h6":
        hi, lo = np.frombuffer(b, "<u4", n, p), np.frombuffer(b, "<u2", n, p + 4 * n)
        return (hi.astype(_U) << _U(32)) | (lo.astype(_U) << _U(16)), p + 6 * n
    a = np.frombuffer(b, kind, n, p)
    return a, p + a.nbytes


def pack(kinds: tuple[str, ...], arrays) -> bytes:
    return len(arrays[0]).to_bytes(8, "little") + b"".join(_put(k, a) for k, a in zip(kinds, arrays, strict=True))


def unpack(kinds: tuple[str, ...], blob) -> list[np.ndarray]:
    b, p, out = memoryview(blob), 8, []
    n = int.from_bytes(b[:8], "little")
    for k in kinds:
        a, p = _get(k, b, p, n)
        out.append(a)
    return out


def unpack_all(kinds: tuple[str, ...], blobs: list) -> list[np.ndarray]:
    parts = [unpack(kinds, b) for b in blobs]
    if not parts:
        return [np.zeros(0, _U if k == "h6" else np.int64 if k in ("doc", "pos") else k) for k in kinds]
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


BLOB = "bucket int, kind int, blob binary"
_BLOB_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])


def deal(bucket: np.ndarray, kind: int, kinds: tuple[str, ...], arrays, rows: list) -> None:
    """Append to `rows` one (bucket, kind, blob) for each bucket with items."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    arrays = [a[order] for a in arrays]
    b = bucket[order]
    cut = np.concatenate(([0], np.flatnonzero(b[1:] != b[:-1]) + 1, [len(b)]))
    for i, j in zip(cut[:-1], cut[1:], strict=True):
        rows.append((int(b[i]), kind, pack(kinds, [a[i:j] for a in arrays])))


def blob_batch(rows: list) -> pa.RecordBatch:
    b, k, x = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(x, pa.binary())], schema=_BLOB_ARROW)


def bucket_of(key: np.ndarray, n: int) -> np.ndarray:
    """Bucket of fingerprints, from bits that their sorting doesn't need."""
    return ((key >> _U(24)) % _U(n)).astype(np.int32)


def doc_bucket(doc: np.ndarray, n: int) -> np.ndarray:
    return bucket_of(mix(doc.astype(_U)), n)


def by_doc(kinds):
    """One row for each document: its items packed, and whether any has the last field set."""

    def run(batches):
        got = unpack_all(kinds, [x.as_buffer() for batch in batches for x in batch.column(2)])
        doc = got[0]
        order = np.lexsort((got[1], doc))
        got = [a[order] for a in got]
        doc = got[0]
        cut = np.concatenate(([0], np.flatnonzero(doc[1:] != doc[:-1]) + 1, [len(doc)])) if len(doc) else np.zeros(1, np.int64)
        ids, items, flags = [], [], []
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            ids.append(int(doc[i]))
            items.append(pack(kinds[1:], [a[i:j] for a in got[1:]]))
            flags.append(bool(got[-1][i:j].any()))
            if len(ids) == 4096:
                yield _doc_batch(ids, items, flags)
                ids, items, flags = [], [], []
        yield _doc_batch(ids, items, flags)

    return run


def _doc_batch(ids, items, flags):
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(items, pa.binary()), pa.array(flags, pa.bool_())], names=["rid", "items", "flag"])


BY_DOC = "rid long, items binary, flag boolean"


def exchange(df: DataFrame, n: int) -> DataFrame:
    """Send each bucket to the partition of its number."""
    return df.repartitionById(n, F.col("bucket"))


def tidy(run):
    """`run`, giving memory back when its task ends: workers stay, and the next stage needs it."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            import contextlib
            import ctypes
            import gc

            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(columns, *names: str) -> list[str]:
    """Names like these that none of the columns has (in any case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text; null counts as empty."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(t), F.xxhash64(t, F.lit(1))]


#: Rows of a table with one row a key that are broadcast at most, and share (1/HOT) of the rows from which on a key is hot.
SMALL, HOT = 1000, 1000


def split_join(left: DataFrame, right: DataFrame, on: list[str], weight: str, spread: list[Column]) -> DataFrame:
    """Left join to a table with one row for each key, `weight` being how many left rows have it.

    A table of at most SMALL rows is broadcast.  Of a larger one only keys with
    over 1/HOT of the weight are (fewer than HOT rows, however large the tables);
    left rows of those need no partner and are spread by `spread`, the others meet
    in a shuffle.  `right` must be cheap to read again.
    """
    n, total = right.agg(F.count(F.lit(1)), F.sum(weight)).first()
    if n <= SMALL:
        return left.join(F.broadcast(right), on, "left")
    own, apart = fresh([*left.columns, *right.columns], "own", "apart")
    values = [c for c in right.columns if c not in on]
    is_hot = F.col(weight).cast("decimal(38,0)") * HOT > F.lit(int(total))
    hot = right.filter(is_hot).select(*on, F.struct(*values).alias(own))
    cold = right.filter(~is_hot).withColumn(apart, F.lit(0).cast("long"))
    out = left.join(F.broadcast(hot), on, "left").withColumn(apart, F.when(F.col(own).isNotNull(), F.xxhash64(*spread)).otherwise(F.lit(0).cast("long")))
    out = out.join(cold.hint("shuffle_hash"), [*on, apart], "left")
    return out.select(*left.columns, *[F.coalesce(F.col(own)[c], F.col(c)).alias(c) for c in values])


#: Equal rows that one task numbers at most.
EQUAL = 10_000


def ordered_rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(rid, doc_id, text), rid a long that is unique and orders the rows; and whether it is the id.

    It is the id itself where ids are unique and not null.  Otherwise rows are
    numbered in the order of id (null first), then a hash of the text: what is
    sorted are ids and hashes, once for each pair, in parts by range; texts (null
    as empty) only move to meet their numbers, equal ones as one.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    odd = base.groupBy("doc_id").count().filter(F.col("doc_id").isNull() | (F.col("count") > 1))
    if not odd.limit(1).count():
        return base.select(F.col("doc_id").alias("rid"), "doc_id", "text").filter("rid is not null"), True
    n = partitions(spark)
    key, (one, two) = ["given", "id", "one", "two"], text_key(F.col("text"))
    base = base.select(F.col("doc_id").isNotNull().alias("given"), F.coalesce("doc_id", F.lit(0)).alias("id"), one.alias("one"), two.alias("two"), F.coalesce("text", F.lit("")).alias("text"))
    keys = base.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).repartitionByRange(n, *key)
    keys = checkpoint(keys.withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(*key)
    # one row for each part: their running sum may be had in one task
    start = keys.groupBy("part").agg(F.sum("n").alias("size"), F.max("n").alias("most"))
    start = checkpoint(start.withColumn("before", F.sum("size").over(Window.orderBy("part")) - F.col("size")))
    keys = keys.withColumn("at", F.sum("n").over(inside) - F.col("n")).join(F.broadcast(start.select("part", "before")), "part")
    keys = keys.select(*key, (F.col("before") + F.col("at")).alias("first"))
    rows = base.groupBy(*key).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n")).join(keys.hint("shuffle_hash"), key)
    if (start.agg(F.max("most")).first()[0] or 0) > EQUAL:
        runs = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(EQUAL).cast("long")))
        rows = rows.withColumn("run", runs).withColumns({"first": F.col("first") + F.col("run"), "n": F.least(F.col("n") - F.col("run"), F.lit(EQUAL))}).repartition(n, "first")
    rows = rows.withColumn("rid", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
    return checkpoint(rows.select("rid", F.when(F.col("given"), F.col("id")).alias("doc_id"), "text")), False


def ensure_checkpoints(spark: SparkSession) -> None:
    """Use the cluster's shared folder; only a local session without one, as in tests, gets a folder of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir names no shared folder")
            import tempfile

            folder = tempfile.mkdtemp(prefix="ckpt")
        sc.setCheckpointDir(folder)


def checkpoint(df: DataFrame) -> DataFrame:
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint()
