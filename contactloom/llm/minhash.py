"""Near duplicates: a multi-index Hamming join of b-bit MinHash signatures.

A signature holds K = 64 minima of 16 bits.  It is split into 11 chunks; two
signatures that differ in at most 21 of 64 places have, by the pigeonhole
principle, a chunk with one error at most, so a key is made for each place of
each chunk with that place left open, 64 keys in all.  Documents of a similarity
of 0.85 miss this with a probability below 1e-6.  Documents that share a key are
candidates if their signatures, cut to two bits a place, differ in at most 21
places; before the shuffle, documents that are all but equal to one are gathered
under it with the radius of what it gathered, and by the triangle inequality no
candidate pair falls apart.  Candidates that hang together form a
cell.  Links are confirmed on full shingle sets inside cells: in a small cell all
at once; in a large one first with the cell's least document, and then between
those that aren't linked to it and all, block against block.  A task reports a
spanning forest of the links that it finds, never all pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.llm import blocks as B
from contactloom.llm.components import components

K, CHUNKS = 64, 11
#: Places in which signatures of candidates differ at most.
DISTANCE = 2 * CHUNKS - 1
#: Places in which documents differ at most that are gathered under one, and documents of a key, in a batch and in
#: all, from which on all that are near are: fewer then stand for the rest, and their cells are wider.
ALIKE, MANY, MANY_IN_ALL = 2, 1024, 16_384
#: Members of a block of a cell.
BLOCK = 256
SHINGLES = "rid long, doc_id long, text_hash long, n_shingles long, set_hash binary, signature binary"
#: key (48 bits: distances are looked at anyway), document, radius, signature of two bits a place
ITEM = ("h6", "doc", "<u1", "<u8", "<u8")

_CUTS = [(i * K // CHUNKS, (i + 1) * K // CHUNKS) for i in range(CHUNKS)]


def shingle_sets(column: pa.Array, width: int):
    """(first row, hashes, row) of the distinct shingles of chunks of texts."""
    chars, grams, whole = B.Poly(9), B.Poly(10), B.Poly(11)
    for i, data, at in B.chunks(column):
        data = B.LOWER[data]
        starts, ends, first = B.split_words(data, at)
        h = chars.slices(chars.sums(chars.table[data]), starts, ends)
        p = B.fits(first, width)
        g, row = grams.slices(grams.sums(h), p, p + width), B.rows_of(first)[p]
        # shorter texts: the whole sequence is the one shingle
        n = np.diff(first)
        short = np.flatnonzero((n > 0) & (n < width))
        if len(short):
            g = np.concatenate((g, whole.slices(whole.sums(h), first[short], first[short + 1]) + n[short].astype(np.uint64)))
            row = np.concatenate((row, short))
        order = np.lexsort((g, row))
        g, row = g[order], row[order]
        new = np.ones(len(g), dtype=bool)
        new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
        yield i, g[new], row[new], len(at) - 1


def _signatures(g: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """K minima of 16 bits for each set [cut[i], cut[i+1]) of g; sets aren't empty."""
    rng = np.random.default_rng(12)
    mul = rng.integers(0, 1 << 31, K, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 1 << 32, K, dtype=np.int64).astype(np.uint32)
    x = (g >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(cut) - 1, K), np.uint16)
    for k in range(K):
        y = x * mul[k]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        y += add[k]
        y ^= y >> np.uint32(13)
        m = np.minimum.reduceat(y, cut[:-1])
        m *= np.uint32(0x85EBCA6B)
        out[:, k] = (m >> np.uint32(16)).astype(np.uint16)
    return out


def _keys(sig: np.ndarray) -> np.ndarray:
    """Keys of signatures: each chunk with each of its places left open."""
    rng = np.random.default_rng(13)
    weight = rng.integers(1, 1 << 62, K, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    terms = B.mix((sig.astype(np.uint64) + np.uint64(1)) * weight)
    out = np.empty((len(sig), K), np.uint64)
    for a, b in _CUTS:
        total = terms[:, a:b].sum(axis=1, dtype=np.uint64)
        for p in range(a, b):
            out[:, p] = B.mix(total - terms[:, p] + weight[p])
    return out


def _sketch(width: int):
    def run(batches):
        for batch in batches:
            size, sets, keys = [], [], []
            for _, g, row, n in shingle_sets(batch.column(2), width):
                count = np.bincount(row, minlength=n)
                cut = np.concatenate(([0], np.cumsum(count)))
                full = np.flatnonzero(count)
                sig = iter(_signatures(g, np.append(cut[full], cut[-1])) if len(full) else ())
                size += count.tolist()
                for r in range(n):
                    own = g[cut[r] : cut[r + 1]]
                    sets.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                    keys.append(next(sig).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(size, pa.int64()), pa.array(sets, pa.binary()), pa.array(keys, pa.binary())],
                names=["rid", "doc_id", "text_hash", "n_shingles", "set_hash", "signature"],
            )

    return run


def _short(sig: np.ndarray) -> np.ndarray:
    """The two lowest bits of each of the K places, in two numbers."""
    at = (np.arange(K, dtype=np.uint64) % np.uint64(32)) * np.uint64(2)
    bits = (sig.astype(np.uint64) & np.uint64(3)) << at
    return np.stack((bits[:, : K // 2].sum(axis=1, dtype=np.uint64), bits[:, K // 2 :].sum(axis=1, dtype=np.uint64)), axis=1)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places in which short signatures differ; never more than the whole ones do."""
    x = a ^ b
    return np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=1, dtype=np.int64)


def gather(key: np.ndarray, doc: np.ndarray, radius: np.ndarray, sig: np.ndarray, many: int):
    """A forest of edges between documents that share a key, and the places and radii of those that stand for the rest.

    Items are sorted by key.  In each round the first document of a key is joined
    with those near to it, and gathers those that are all but equal to it (of a
    key with over `many` documents, all that are near): they leave, and its radius
    covers them.  Others may be near to something that it gathered, so what lies
    within the radius more is joined, too.  A key is done when all that it has
    left is of one tree and a round gathers little; what is left stands for itself.
    """
    pool = np.arange(len(key))
    if len(key):
        cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        size = np.diff(cut)
        reach_of = np.repeat(np.where(size > many, DISTANCE, ALIKE), size)
    radius, tree = radius.astype(np.int64), np.arange(len(key))
    stay, edges = [], [np.zeros((2, 0), np.int64)]

    def roots(at):
        r = tree[at]
        while True:
            up = tree[r]
            if (up == r).all():
                tree[at] = r
                return r
            r = up

    while len(pool):
        k = key[pool]
        new = np.ones(len(pool), dtype=bool)
        new[1:] = k[1:] != k[:-1]
        group = np.cumsum(new) - 1
        head = pool[new]
        stay.append(head)
        rest = ~new
        pool, group = pool[rest], group[rest]
        d = _distance(sig[head[group]], sig[pool])
        near = d <= reach_of[pool]
        reach = radius[head]
        np.maximum.at(reach, group[near], d[near] + radius[pool[near]])
        reach = np.minimum(reach, K)
        radius[head] = reach
        linked = np.flatnonzero(d <= DISTANCE + reach[group] + radius[pool])
        # one edge joins a tree to that of the head
        top, own = roots(head), roots(pool)
        other = linked[own[linked] != top[group[linked]]]
        _, first = np.unique(own[other], return_index=True)
        other = other[first]
        edges.append(np.stack((doc[head[group[other]]], doc[pool[other]])))
        tree[own[other]] = top[group[other]]
        pool, group, left = pool[~near], group[~near], np.bincount(group, minlength=len(head))
        gathered = np.bincount(group, minlength=len(head)) * 10 <= left * 9
        apart = np.bincount(group[roots(pool) != roots(head)[group]], minlength=len(head)) > 0
        on = (gathered | apart)[group]
        stay.append(pool[~on])
        pool = pool[on]
    at = np.sort(np.concatenate(stay)) if stay else np.zeros(0, np.int64)
    return np.unique(np.sort(np.concatenate(edges, axis=1), axis=0), axis=1), at, radius[at]


def _deal_keys(n: int):
    def run(batches):
        for batch in batches:
            rows: list = []
            rid = batch.column(0).to_numpy()
            if len(rid):
                sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(len(rid), K)
                key, at = _keys(sig).ravel() & ~np.uint64(0xFFFF), np.repeat(np.arange(len(rid)), K)
                order = np.lexsort((at, key))
                key, at = key[order], at[order]
                short = _short(sig)
                pair, stay, radius = gather(key, rid[at], np.zeros(len(key), np.uint8), short[at], MANY)
                B.deal(B.doc_bucket(pair[1], n), 1, ("<i8", "<i8"), (pair[0], pair[1]), rows)
                back = np.argsort(at[stay], kind="stable")
                key, at, radius = key[stay][back], at[stay][back], radius[back]
                B.deal(B.bucket_of(key, n), 0, ITEM, (key, rid[at], radius.astype(np.uint8), short[at, 0], short[at, 1]), rows)
            yield B.blob_batch(rows)

    return run


def _meet(batches):
    """Candidate pairs, as edges that hold together what hangs together."""
    blobs = []
    for batch in batches:
        for kind, blob in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            if kind == 0:
                blobs.append(blob.as_buffer())
            else:
                a, b = B.unpack(("<i8", "<i8"), blob.as_buffer())
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
    key, doc, radius, one, two = B.unpack_all(ITEM, blobs)
    del blobs
    # only keys that occur again are looked at
    order = np.argsort(key, kind="stable")
    k = key[order]
    more = np.zeros(len(k), dtype=bool)
    more[1:] |= k[1:] == k[:-1]
    more[:-1] |= k[1:] == k[:-1]
    order = order[more]
    order = order[np.lexsort((doc[order], key[order]))]
    pair, _, _ = gather(key[order], doc[order], radius[order], np.stack((one[order], two[order]), axis=1), MANY_IN_ALL)
    yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])


class _Forest:
    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, i: int) -> int:
        r = self.root
        while r[i] != i:
            r[i] = r[r[i]]
            i = r[i]
        return i

    def all(self) -> np.ndarray:
        r = self.root
        while (r[r] != r).any():
            r = r[r]
        self.root = r
        return r


def _links(rid: np.ndarray, sets: list[np.ndarray], own: np.ndarray, percent: int):
    """Edges of a spanning forest of the links between (or, if one block, in) blocks.

    Documents are taken in turn; what a document shares with all others is
    counted through lists of the documents of each shingle, and only documents of
    other trees are looked at.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    member = np.repeat(np.arange(n), size)
    order = np.argsort(every, kind="stable")
    every, member = every[order], member[order]
    values, start = np.unique(every, return_index=True)
    end = np.append(start[1:], len(every))
    forest, both = _Forest(n), len(np.unique(own)) > 1
    for i in range(n):
        if both and own[i] != own[0]:
            continue  # pairs go from the first block to the second
        at = np.searchsorted(values, sets[i])
        s, e = start[at], end[at]
        more = e - s > 1
        s, e = s[more], e[more]
        if not len(s):
            continue
        k = e - s
        place = np.repeat(s - np.concatenate(([0], np.cumsum(k)[:-1])), k) + np.arange(k.sum())
        shared = np.bincount(member[place], minlength=n)
        linked = 100 * shared >= percent * (size[i] + size - shared)
        linked[i] = False
        if both:
            linked &= own != own[i]
        if not linked.any():
            continue
        trees = forest.all()
        mine = trees[i]
        for j in np.flatnonzero(linked & (trees != mine)):
            t = forest.find(j)
            r = forest.find(i)
            if t != r:
                forest.root[max(t, r)] = min(t, r)
                yield rid[i], rid[j]


def _star(rid: np.ndarray, sets: list[np.ndarray], root: int, percent: int):
    """Edges from the root to the documents that it is linked with."""
    own = sets[int(np.flatnonzero(rid == root)[0])]
    for r, s in zip(rid.tolist(), sets, strict=True):
        if r != root:
            shared = np.intersect1d(own, s, assume_unique=True).size
            if 100 * shared >= percent * (len(own) + len(s) - shared):
                yield root, r


def _confirm(percent: int, star: bool):
    """Links in what meets: (cell, one, two, block, rid, shingles); two is -1 where a block meets its cell's least document."""

    def run(batches):
        cells: dict = {}
        for batch in batches:
            for cell, one, two, block, rid, blob in zip(*(c.to_pylist() for c in batch.columns[:5]), batch.column(5), strict=True):
                cells.setdefault((cell, one, two), []).append((block, rid, np.frombuffer(blob.as_buffer(), np.uint64)))
        while cells:
            (cell, one, two), rows = cells.popitem()
            rows.sort(key=lambda r: (r[0], r[1]))
            rid, sets = np.array([r[1] for r in rows]), [r[2] for r in rows]
            own = np.array([r[0] for r in rows])
            if not star and len(np.unique(own)) < 2:
                continue  # nothing is open here
            found = list(_star(rid, sets, cell, percent) if star and two < 0 else _links(rid, sets, own, percent))
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _sets_of(width: int):
    def run(batches):
        for batch in batches:
            out = []
            for _, g, row, n in shingle_sets(batch.column(1), width):
                cut = np.searchsorted(row, np.arange(n + 1))
                out += [g[cut[r] : cut[r + 1]].tobytes() for r in range(n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(out, pa.binary())], names=["rid", "component", "block", "blocks", "shingles"])

    return run


MET = ("component", "one", "two", "block", "rid", "shingles")
LINKS = "a long, b long"


def _met(df: DataFrame, n: int, work) -> DataFrame:
    df = df.withColumn("bucket", F.pmod(F.xxhash64("component", "one", "two"), F.lit(n)).cast("int"))
    return B.exchange(df, n).select(*MET).mapInArrow(B.tidy(work), LINKS)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row: id, n_shingles, component_id, whether it stays, and its row's number.

    Words are those of the lower-cased (A-Z) text; the set of a text is its
    distinct shingles of `width` words, or its whole sequence if it is shorter.
    Rows are linked when 100 * intersection >= `percent` * union, on full sets;
    rows without words are linked with nothing.  component_id is the least id
    reachable over links (a null id counts only where there is no other); kept
    says whether it is the row's own.  A null id, or one that occurs again, makes
    rows of their own: rid numbers them by id, null first, and first marks the one
    row of a component with the least number.  text_hash is xxhash64 of the text.
    Other columns are not read; an empty table gives no rows.  `percent` is 80 or
    more.
    """
    if percent < 80:
        raise ValueError("the signature distance is set for a similarity of 0.8 or more")
    spark = docs.sparkSession
    n = B.partitions(spark)
    rows, plain = B.ordered_rows(docs, id_col, text_col)
    sketch = rows.withColumn("text_hash", B.text_key(F.col("text"))[0]).mapInArrow(B.tidy(_sketch(width)), SHINGLES)
    sketch = B.checkpoint(sketch)
    # equal sets are linked, and one document stands for them from here on
    same = sketch.filter("n_shingles > 0").groupBy("set_hash")
    same = same.agg(F.min("rid").alias("head"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("signature").alias("signature"))
    same = B.checkpoint(same)
    keys = same.select("head", "signature").mapInArrow(B.tidy(_deal_keys(n)), B.BLOB)
    near = B.exchange(keys, n).mapInArrow(B.tidy(_meet), LINKS).distinct()
    cells = components(near)
    sizes = B.checkpoint(cells.groupBy("component").agg(F.count(F.lit(1)).alias("members")))
    placed = B.split_join(cells, sizes, ["component"], "members", [F.col("node")])
    placed = placed.withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    texts = rows.join(placed.select(F.col("node").alias("rid"), "component", "block", "blocks").hint("shuffle_hash"), "rid")
    sets = texts.select("rid", "text", "component", "block", "blocks").mapInArrow(B.tidy(_sets_of(width)), "rid long, component long, block int, blocks int, shingles binary")
    large = sizes.filter(F.col("members") > BLOCK).limit(1).count() > 0
    sets = B.checkpoint(sets) if large else sets
    # a cell of one block is compared in one task; in others each block meets the cell's least document
    root = (F.col("rid") == F.col("component")) & (F.col("blocks") > 1)
    to = F.when(root, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    met = sets.withColumn("one", F.explode(to)).withColumn("two", F.when(F.col("blocks") > 1, -1).otherwise(0))
    links = _met(met, n, _confirm(percent, True))
    if large:
        links = B.checkpoint(links)
        # what isn't linked to it meets every block of its cell
        big = sets.filter("blocks > 1")
        rest = big.filter("rid <> component").join(links.select(F.col("b").alias("rid")).hint("shuffle_hash"), "rid", "left_anti")
        rest = B.checkpoint(rest)
        count = B.checkpoint(rest.groupBy("component").agg(F.count(F.lit(1)).alias("open")))
        count = count.join(sizes, "component").withColumn("others", F.ceil(F.col("open") / BLOCK).cast("int")).select("component", "members", "open", "others")
        count = B.checkpoint(count)
        every = B.split_join(big, count, ["component"], "members", [F.col("rid")]).filter("others is not null")
        every = every.select("component", F.col("block").alias("one"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("two"), F.lit(0).alias("block"), "rid", "shingles")
        some = B.split_join(rest, count, ["component"], "open", [F.col("rid")]).withColumn("two", F.pmod(F.xxhash64("rid", F.lit(2)), F.col("others")).cast("int"))
        some = some.select("component", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("one"), "two", F.lit(1).alias("block"), "rid", "shingles")
        links = links.unionByName(_met(every.unionByName(some), n, _confirm(percent, False)))
    final = components(links)
    # a document takes the component of the one that stands for its set
    label = same.join(final.hint("shuffle_hash"), F.col("head") == F.col("node"), "left").select("set_hash", "head", "least", "copies", F.coalesce("component", "head").alias("root"))
    label = B.checkpoint(label.filter("copies > 1 or head <> root"))
    out = sketch.select("rid", "doc_id", "text_hash", "n_shingles", F.coalesce("set_hash", F.expr("cast(rid as string)").cast("binary")).alias("set_hash"))
    out = B.split_join(out, label.select("set_hash", "root", "copies"), ["set_hash"], "copies", [F.col("rid")])
    out = out.drop("copies").withColumn("root", F.coalesce("root", "rid"))
    if plain:
        out = out.withColumn("component_id", F.col("root"))
    else:
        # the roots' numbers aren't ids: the least id of each component is
        ids = same.join(final.hint("shuffle_hash"), F.col("head") == F.col("node"), "left").groupBy(F.coalesce("component", "head").alias("root"))
        ids = B.checkpoint(ids.agg(F.min("least").alias("least"), F.sum("copies").alias("copies")))
        out = B.split_join(out, ids, ["root"], "copies", [F.col("rid")])
        out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")))
    return out.select("rid", "doc_id", "text_hash", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), (F.col("rid") == F.col("root")).alias("first"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that stay, as they are: one of each component, the one of the least id.

    The decision is on the row, not on its id: where an id stands on several
    texts each is judged by its own component, and of rows that repeat id and
    text one stays.  Nulls, empty texts and empty tables as for near_duplicates;
    any column names may occur.
    """
    found = B.checkpoint(near_duplicates(docs, id_col, text_col, width, percent).select("doc_id", "text_hash", "first"))
    own, key, other, hash_ = B.fresh(docs.columns, "own", "key", "other", "hash")
    left = docs.withColumns({own: F.col(id_col).cast("long"), key: B.text_key(F.col(text_col))[0]})
    # equal rows go as one; they are only looked for where there are some
    if found.groupBy("doc_id", "text_hash").count().filter("count > 1").limit(1).count():
        left = left.dropDuplicates([own, key])
    stay = found.filter("first").select(F.col("doc_id").alias(other), F.col("text_hash").alias(hash_))
    out = left.join(stay.hint("shuffle_hash"), F.col(own).eqNullSafe(F.col(other)) & (F.col(key) == F.col(hash_)), "left_semi")
    return out.select(*docs.columns)
