"""Hierarchical residual packing of token sequences.

Documents are tokenised where they are read; only pieces' lengths move.  Whole
pieces are sequences as they are.  Parts of the others, of about ITEMS pieces
however many there are, are packed best-fit (longest first) side by side.  Nearly
full bins leave; the emptiest others travel up a tree as items with their
contents.  At each node the bins of the children are packed best-fit again, as
they are or opened into their pieces, whichever takes fewer bins.  What the tree
leaves with room, however many bins, is then packed best-fit as a whole: by the
number of bins of each size, of which there are 1,023.  So no two sequences fit
into one.
"""

from __future__ import annotations

import base64
import bisect
import functools
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactloom.llm import blocks as B

LIMIT, END = 1024, 2
#: Children of a node of the tree.
FAN = 8
#: Pieces of a part; smaller parts would leave more room to the tree.
ITEMS = 2000
#: Tokens that a nearly full bin has room for at most, and bins of a node that go up at most; all others wait for the packing by sizes.
ROOM, UP = 8, 64


class Tokens:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    `path` is a file of the `tokenizers` library.  For the public vocabulary its
    ranks file gives the same ids several times faster and is used for all texts
    but those that hold the string of a special token, which `tokenizers` reads as
    that token, and those that the faster reader refuses; the tests compare both.
    """

    SPECIAL = "<|endoftext|>"

    def __init__(self, path: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.fast = None
        if path is None:
            import public_tokenizers
            import tiktoken

            path = public_tokenizers.path("byte_bpe_50k.json")
            with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.tokenizer = Tokenizer.from_file(path)

    def _one(self, text: str) -> bytes:
        if self.fast is not None and self.SPECIAL not in text:
            try:
                return np.array(self.fast(text), "<u4").tobytes()
            except Exception:  # noqa: BLE001  its pattern engine gives up on some texts; the other one reads all
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self._one(t) for t in texts]


@functools.cache
def tokens(path: str | None) -> Tokens:
    """The worker's own tokenizer, kept from task to task."""
    return Tokens(path)


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, mark long"


def _pieces(path: str | None, keep_ids: bool):
    def run(batches):
        known, end, row = tokens(path), np.array([END], "<u4").tobytes(), 0
        for batch in batches:
            doc = batch.column(0).to_pylist()
            step = 256
            for i in range(0, len(doc), step):
                out = [[] for _ in range(7)]
                texts = [t or "" for t in batch.column(1).slice(i, step).to_pylist()]
                for j, ids in enumerate(known.encode(texts)):
                    ids += end
                    row += 1
                    n = len(ids) // 4
                    # the first piece takes what is over, the others are full
                    cuts = [0, *range(n % LIMIT or LIMIT, n + 1, LIMIT)]
                    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        own = ids[4 * a : 4 * b]
                        # equal rows get marks of their own by their place
                        mark = zlib.crc32(f"{doc[i + j]} {k} {row}".encode())
                        for col, v in zip(out, (doc[i + j], k, a, b - a, zlib.crc32(own), own if keep_ids else None, mark), strict=True):
                            col.append(v)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "mark"])

    return run


def best_fit(sizes: list[int], limit: int = LIMIT) -> list[list[int]]:
    """Places of the items of each bin: longest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(limit + 1)]  # bins by the room they have
    mask = 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        s = sizes[i]
        fit = mask >> s
        if fit:
            r = s + ((fit & -fit).bit_length() - 1)
            b = room[r].pop()
            if not room[r]:
                mask &= ~(1 << r)
            bins[b].append(i)
        else:
            r, b = limit, len(bins)
            bins.append([i])
        left = r - s
        room[left].append(b)
        mask |= 1 << left
    return bins


def fill(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[int, list[tuple[int, int, int, int]]]]:
    """`best_fit` of any number of items, known by the number of each size: (bins, members) of each kind of bin that holds several items.

    A member is (size, first, each, offset): bin b of the kind holds the items first + b * each and on, `each` in all, of
    that size from that offset.  The work grows with the sizes, not with the items.
    """
    room: list[list[tuple[int, list]]] = [[] for _ in range(limit + 1)]
    mask = 0
    for s in sorted(counts, reverse=True):
        at, left = 0, counts[s]
        while left:
            # an item makes its bin the tightest, so the next ones go there while they fit
            fit = mask >> s
            r = s + ((fit & -fit).bit_length() - 1) if fit else limit
            each = min(left, r // s)
            bins, held = room[r].pop() if fit else (left // each, [])
            n = min(bins, left // each)
            if bins > n:
                room[r].append((bins - n, [(x, a + n * k, k, o) for x, a, k, o in held]))
            if not room[r]:
                mask &= ~(1 << r)
            room[r - s * each].append((n, [*held, (s, at, each, limit - r)]))
            mask |= 1 << (r - s * each)
            at, left = at + n * each, left - n * each
    return [(n, held) for kinds in room for n, held in kinds if sum(k for _, _, k, _ in held) > 1]


def _placed(kinds: list[tuple[int, list[tuple[int, int, int, int]]]]):
    """(number, sequence, shift) of bins (number, size, rank) that share a sequence, by what `fill` says; others give no row."""
    moves: dict[int, list] = {}
    first = 0
    for n, held in kinds:
        for s, a, k, o in held:
            moves.setdefault(s, []).append((a, a + n * k, k, first, o))
        first += n
    for m in moves.values():
        m.sort()

    def run(batches):
        for batch in batches:
            out = [[], [], []]
            for number, size, rank in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                m = moves[size]
                i = bisect.bisect_right(m, rank, key=lambda x: x[0]) - 1
                if i >= 0 and rank < m[i][1]:
                    a, _, k, b, o = m[i]
                    # numbers below zero, which the rows' own never are
                    for col, v in zip(out, (number, -1 - b - (rank - a) // k, o + (rank - a) % k * size), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["number", "sequence", "shift"])

    return sorted(moves), run


def _together(every: DataFrame) -> DataFrame:
    """Bins (size, items) numbered by sequence_id, with the shift of their pieces; those that best fit puts together share one.

    Only numbers and sizes are ranked: in each size by the partition, then by the row.
    """
    # the rows of checkpoints stay in place, so their numbers do
    every = every.withColumn("number", F.monotonically_increasing_id())
    left = {x["size"]: x["count"] for x in every.filter(F.col("size") < LIMIT).groupBy("size").count().collect()}
    sizes, run = _placed(fill(left))
    alone = every.select(F.col("number").alias("sequence_id"), F.lit(0).cast("long").alias("shift"), "items", "size")
    if not sizes:
        return alone
    some = every.filter(F.col("size").isin(sizes))
    e = some.select("number", "size", F.shiftright("number", 33).alias("part"))
    before = e.groupBy("size", "part").count()
    before = before.select("size", "part", (F.sum("count").over(Window.partitionBy("size").orderBy("part")) - F.col("count")).alias("before"))
    ranked = e.withColumn("own", F.row_number().over(Window.partitionBy("size", "part").orderBy("number"))).join(before, ["size", "part"])
    places = ranked.select("number", "size", (F.col("before") + F.col("own") - 1).alias("rank")).mapInArrow(run, "number long, sequence long, shift long")
    moved = some.join(places, "number", "left").select(F.coalesce("sequence", "number").alias("sequence_id"), F.coalesce("shift", F.lit(0)).cast("long").alias("shift"), "items")
    return alone.filter(~F.col("size").isin(sizes)).drop("size").unionByName(moved)


_FIELDS = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
BIN = "node long, up boolean, size long, items array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,ids:binary,offset:long>>"
_ITEM = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()), ("offset", pa.int64())])


def _size(items: list[dict]) -> int:
    return sum(x["length"] for x in items)


def _packed(items: list[list[dict]]) -> list[list[dict]]:
    return [[x for k in b for x in items[k]] for b in best_fit([_size(i) for i in items])]


def _bins(node: int, items: list[list[dict]], last: bool) -> pa.RecordBatch:
    """Pack lists of pieces as items, or their pieces; tell which bins go up."""
    packed = _packed(items)
    if any(len(i) > 1 for i in items):
        packed = min(packed, _packed([[x] for i in items for x in i]), key=len)
    total = [_size(b) for b in packed]
    open_ = [i for i in sorted(range(len(packed)), key=lambda i: total[i]) if total[i] < LIMIT - ROOM]
    up = set() if last else set(open_[:UP])
    for b in packed:
        at = 0
        for x in b:
            x["offset"] = at
            at += x["length"]
    return pa.RecordBatch.from_arrays([pa.array([node] * len(packed), pa.int64()), pa.array([i in up for i in range(len(packed))], pa.bool_()), pa.array(total, pa.int64()), pa.array(packed, pa.list_(_ITEM))], names=["node", "up", "size", "items"])


def _pack(last: bool):
    """Packs nodes one by one; their rows (node, items) follow each other."""

    def run(batches):
        node, items = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["node"] != node and items:
                    yield _bins(node, items, last)
                    items = []
                node = row["node"]
                items.append(row["items"])
        if items:
            yield _bins(node, items, last)

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most 1024 tokens.

    A document is its text's ids and then id 2; null is empty.  Longer ones are
    cut into 1024-token pieces of which the first may be shorter.  Returns, per
    piece, doc_id, piece, start, length, ids_crc32 (of little-endian unsigned
    32-bit ids), sequence_id, offset, and the ids if asked for.  Every row is a
    document of its own, whatever its id (null, repeated); other columns are not
    read; an empty table gives no rows.  `path` is the tokenizer's file.
    """
    n = B.partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = B.checkpoint(rows.mapInArrow(_pieces(path, keep_ids), PIECE))
    # full pieces are sequences as they are, and stay where they are
    done = [pieces.filter(F.col("length") == LIMIT).select(F.col("length").alias("size"), F.array(F.struct(*_FIELDS, F.lit(0).cast("long").alias("offset"))).alias("items"))]
    rest = pieces.filter(F.col("length") < LIMIT)
    nodes = max(1, -(-rest.count() // ITEMS))
    item = F.array(F.struct(*_FIELDS, F.lit(0).cast("long").alias("offset"))).alias("items")
    level = rest.select(F.pmod("mark", F.lit(nodes)).alias("node"), item)

    def packed(df: DataFrame, nodes: int) -> DataFrame:
        """Each node's rows lie side by side in a task, which holds one node at a time."""
        tasks = min(n, nodes)
        order = [F.col("items")[0][c] for c in ("doc_id", "piece", "ids_crc32", "length")]
        dealt = df.repartitionById(tasks, F.pmod("node", F.lit(tasks)).cast("int")).sortWithinPartitions("node", *order)
        return B.checkpoint(dealt.mapInArrow(_pack(nodes == 1), BIN))

    while True:
        bins = packed(level, nodes)
        done.append(bins.filter("not up").select("size", "items"))
        if nodes == 1:
            break
        level = bins.filter("up").select(F.floor(F.col("node") / FAN).cast("long").alias("node"), "items")
        nodes = -(-nodes // FAN)
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    out = _together(every).select("sequence_id", "shift", F.explode("items").alias("p"))
    out = out.select("p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", "sequence_id", (F.col("p.offset") + F.col("shift")).alias("offset"), "p.ids")
    return out if keep_ids else out.drop("ids")
