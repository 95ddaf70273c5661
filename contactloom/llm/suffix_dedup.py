"""Duplicate passages by prefix doubling over a sparse set of suffixes.

Ranks are content fingerprints, so equal prefixes have equal ranks on every
machine, and the rank of a pair (prefix, prefix at an offset) can be had where
the text is.  Spark sorts (rank, position) at growing lengths, a quarter of the
threshold at first, then twice as much in each round:

1. At each length, the positions that a minimum over every 100 bytes picks (any
   two equal 100-byte strings pick the same offset).  A position whose rank is
   unique leaves with all the strings that picked it.
2. For the others, the pair of that rank and the rank of the run of 100-byte
   strings around it.  All but the first of an equal run are repeats, whole.
   A run that is the only one of its pair of ranks needs no further round,
   unless other runs share its first rank.  Where a batch has more than two runs
   of one rank, it isn't unique: the others go to the next length at once.
3. What is left goes to the next round, where only its strings pick again.  At
   the threshold every 100-byte string is ranked, as the pair of the ranks of its
   halves.  All but the first of equal ones are repeats.

Every repeated string is found: the rounds only leave out strings that are
known to be unique or already decided.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.llm import blocks as B

#: rank, run's rank, document, first start, number of starts
RUN = ("h6", "<u8", "doc", "pos", "<u1")
#: document, first start, number of starts, 1 if each start is to be ranked alone
FOUND = ("doc", "pos", "<u1", "<u1")
#: rank of a whole string in two parts, document, start
WHOLE = ("<u8", "<u4", "doc", "pos")
#: document, first start, number of starts that repeat
DONE = ("doc", "pos", "<u1")


def _minima(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the first smallest of each `width` consecutive values."""
    n = len(values) - width + 1
    v, at, span = values, np.arange(len(values), dtype=np.int32), 1
    while span * 2 <= width:
        take = v[span:] < v[:-span]
        v, at = np.where(take, v[span:], v[:-span]), np.where(take, at[span:], at[:-span])
        span *= 2
    if span < width:
        d = width - span
        take = v[d:] < v[:-d]
        at = np.where(take, at[d:], at[:-d])
    return at[:n]


def _runs(data: np.ndarray, at: np.ndarray, length: int, part: int, poly: B.Poly, open_: np.ndarray | None):
    """(rank at `part` bytes, run's rank, row, first start, number) of the runs of a chunk, of the open starts only."""
    sums = poly.sums(poly.table[data])
    ranks = poly.windows(sums, part)
    if len(data) < length:
        return None
    pick = _minima((ranks >> np.uint64(32)).astype(np.uint32), length - part + 1)
    starts = B.fits(at, length)  # strings that lie in one row
    if open_ is not None:
        starts = starts[open_[starts]]
    if not len(starts):
        return None
    p = pick[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (p[1:] != p[:-1]) | (starts[1:] != starts[:-1] + 1)
    a = np.flatnonzero(new)
    first, number = starts[a], np.diff(np.append(a, len(starts)))
    row = np.searchsorted(at, first, "right") - 1
    return ranks[p[a]], poly.slices(sums, first, first + number + length - 1), row, first - at[row], number


def _pieces(column: pa.Array, length: int, chunk: int):
    """Chunks of rows; a very long text comes in overlapping slices of one row."""
    for i, data, at in B.chunks(column, chunk):
        if len(at) == 2 and len(data) > 4 * chunk:
            for s in range(0, len(data), chunk):
                part = data[s : s + chunk + length - 1]
                yield i, part, np.array([0, len(part)]), s
        else:
            yield i, data, at, 0


def _open(items: list, i: int, at: np.ndarray, shift: int) -> np.ndarray:
    """The open starts of a chunk whose first row is i, or of a slice of that row."""
    edge = np.zeros(int(at[-1]) + 1, np.int32)
    for r in range(len(at) - 1):
        start, number, _ = items[i + r]
        size = at[r + 1] - at[r]
        np.add.at(edge, at[r] + np.clip(start - shift, 0, size), 1)
        np.add.at(edge, at[r] + np.clip(start + number - shift, 0, size), -1)
    return np.cumsum(edge[:-1]) > 0


def _split(blobs) -> tuple[list, list]:
    """Of each row's runs those that are open, and those that are decided."""
    every = [B.unpack(FOUND[1:], x.as_buffer()) for x in blobs]
    wide = [(s, k.astype(np.int64), a == 1) for s, k, a in every]
    return [(s[a], k[a], a[a]) for s, k, a in wide], [(s[~a], k[~a]) for s, k, a in wide]


def _decided(rid: np.ndarray, done: list):
    doc = np.concatenate([np.full(len(s), r) for r, (s, _) in zip(rid.tolist(), done, strict=True)])
    return doc.astype(np.int64), *(np.concatenate(c) for c in zip(*done, strict=True))


def _rank(length: int, part: int, first: bool, n: int, chunk: int):
    """Ranks at `part` bytes of what is open (at first, all); what is decided is passed on."""

    def run(batches):
        poly = B.Poly(3)
        for batch in batches:
            rid = batch.column(0).to_numpy()
            rows: list = []
            items = None
            if not first and len(rid):
                items, done = _split(batch.column(3))
                doc, start, number = _decided(rid, done)
                B.deal(B.doc_bucket(doc, n), 1, FOUND, (doc, start, number, np.zeros(len(doc), np.uint8)), rows)
            got = []
            for i, data, at, shift in _pieces(batch.column(1 if first else 2), length, chunk):
                open_ = None if items is None else _open(items, i, at, shift)
                if open_ is not None and not open_.any():
                    continue
                if (r := _runs(data, at, length, part, poly, open_)) is not None:
                    rank, run_rank, row, start, number = r
                    got.append((rank, run_rank, rid[row + i], start + shift, number))
            if got:
                rank, run_rank, doc, start, number = (np.concatenate(c) for c in zip(*got, strict=True))
                rank &= ~np.uint64(0xFFFF)
                # of equal runs in a batch the first stands for all; the rest are repeats already
                order = np.lexsort((start, doc, run_rank))
                k = run_rank[order]
                again = np.zeros(len(k), dtype=bool)
                again[1:] = k[1:] == k[:-1]
                rest = np.sort(order[again])
                keep = order[~again]
                # of one rank a batch sends two runs at most, enough to show that it isn't unique; what more there are
                # go on to the threshold from here, so that a frequent rank meets in one task only batch by batch
                keep = keep[np.argsort(rank[keep], kind="stable")]
                third = np.zeros(len(keep), dtype=bool)
                third[2:] = rank[keep][2:] == rank[keep][:-2]
                more, keep = np.sort(keep[third]), np.sort(keep[~third])
                B.deal(B.bucket_of(rank[keep], n), 0, RUN, (rank[keep], run_rank[keep], doc[keep], start[keep], number[keep]), rows)
                B.deal(B.doc_bucket(doc[rest], n), 1, FOUND, (doc[rest], start[rest], number[rest], np.zeros(len(rest), np.uint8)), rows)
                B.deal(B.doc_bucket(doc[more], n), 1, FOUND, (doc[more], start[more], number[more], np.ones(len(more), np.uint8)), rows)
            yield B.blob_batch(rows)

    return run


def _rerank(n: int):
    """Drops unique ranks, and decides on the runs of the others."""

    def run(batches):
        blobs, rows = [], []
        for batch in batches:
            for kind, bucket, blob in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), batch.column(2), strict=True):
                if kind == 0:
                    blobs.append(blob.as_buffer())
                else:
                    rows.append((bucket, 1, blob.as_py()))
            if rows:
                yield B.blob_batch(rows)
                rows = []
        if not blobs:
            return
        rank, run_rank, doc, start, number = B.unpack_all(RUN, blobs)
        del blobs
        order = np.lexsort((start, doc, run_rank, rank))
        rank, run_rank, doc, start, number = (x[order] for x in (rank, run_rank, doc, start, number))
        new_rank = np.ones(len(rank), dtype=bool)
        new_rank[1:] = rank[1:] != rank[:-1]
        first = new_rank.copy()
        first[1:] |= run_rank[1:] != run_rank[:-1]
        group = np.cumsum(new_rank) - 1
        several = np.bincount(group, weights=first)[group] > 1
        out = ~first | several
        doc, start, number, alone = doc[out], start[out], number[out], (first & several)[out].astype(np.uint8)
        B.deal(B.doc_bucket(doc, n), 1, FOUND, (doc, start, number, alone), rows)
        yield B.blob_batch(rows)

    return run


def _covered(first: np.ndarray, number: np.ndarray, extra: int, size: int) -> np.ndarray:
    """Marks [first, first + number + extra) of each run."""
    edge = np.zeros(size + 1, dtype=np.int32)
    np.add.at(edge, first, 1)
    np.add.at(edge, np.minimum(first + number + extra, size), -1)
    return np.cumsum(edge[:-1]) > 0


def _rank_whole(length: int, n: int, chunk: int):
    """All strings of the runs that are still undecided."""

    def run(batches):
        one, two = B.Poly(3), B.Poly(4)
        half = length // 2
        for batch in batches:
            rid = batch.column(0).to_numpy()
            data, at = B.flat(batch.column(2))
            got, rows = [], []
            items, done = _split(batch.column(3))
            if len(rid):
                doc, start, number = _decided(rid, done)
                B.deal(B.doc_bucket(doc, n), 1, DONE, (doc, start, number), rows)
            for i, (start, number, _) in enumerate(items):
                text = data[at[i] : at[i + 1]]
                # of overlapping slices of a long text a run may be told twice
                seen = np.unique(np.repeat(start, number) + np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number))
                for s in range(0, len(text), chunk):
                    own = seen[(seen >= s) & (seen < s + chunk)]
                    if len(own):
                        part, p = text[s : s + chunk + length], own - s
                        rank = [(poly, sums, poly.slices(sums, p, p + half), poly.slices(sums, p + half, p + length)) for poly in (one, two) for sums in [poly.sums(poly.table[part])]]
                        h = [B.mix(a * np.uint64(0x9E3779B97F4A7C15) + b) for _, _, a, b in rank]
                        got.append((h[0], (h[1] >> np.uint64(32)).astype(np.uint32), np.full(len(own), rid[i]), own))
            if got:
                h, g, doc, start = (np.concatenate(c) for c in zip(*got, strict=True))
                order = np.lexsort((start, doc, g, h))
                again = np.zeros(len(h), dtype=bool)
                again[1:] = (h[order][1:] == h[order][:-1]) & (g[order][1:] == g[order][:-1])
                keep, rest = np.sort(order[~again]), np.sort(order[again])
                B.deal(B.bucket_of(h[keep], n), 0, WHOLE, (h[keep], g[keep], doc[keep], start[keep]), rows)
                B.deal(B.doc_bucket(doc[rest], n), 1, DONE, (doc[rest], start[rest], np.ones(len(rest), np.uint8)), rows)
            yield B.blob_batch(rows)

    return run


def later_ones(kinds: tuple[str, ...], n: int, numbered: bool = False):
    """Of items with equal fingerprints all but the first (document, start), dealt by document; if asked for, as runs of one."""

    def run(batches):
        blobs, rows = [], []
        for batch in batches:
            for kind, bucket, blob in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), batch.column(2), strict=True):
                if kind == 0:
                    blobs.append(blob.as_buffer())
                else:
                    rows.append((bucket, 1, blob.as_py()))
            if rows:
                yield B.blob_batch(rows)
                rows = []
        if not blobs:
            return
        h, g, doc, start = B.unpack_all(kinds, blobs)
        del blobs
        order = np.lexsort((start, doc, g, h))
        h, g = h[order], g[order]
        again = np.zeros(len(h), dtype=bool)
        again[1:] = (h[1:] == h[:-1]) & (g[1:] == g[:-1])
        own = order[again]
        kept = (doc[own], start[own], np.ones(len(own), np.uint8))
        B.deal(B.doc_bucket(doc[own], n), 1, DONE if numbered else DONE[:2], kept if numbered else kept[:2], rows)
        yield B.blob_batch(rows)

    return run


def _remove(length: int):
    def run(batches):
        for batch in batches:
            data, at = B.flat(batch.column(2))
            n_bytes, n_removed, n_spans, sha, spans, kept = [], [], [], [], [], []
            for i, runs in enumerate(batch.column(3)):
                text = data[at[i] : at[i + 1]]
                first, number = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if runs.is_valid:
                    first, number = B.unpack(DONE[1:], runs.as_buffer())
                    number = number.astype(np.int64)
                gone = _covered(first, number, length - 1, len(text)) if len(first) else np.zeros(len(text), dtype=bool)
                edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                left = text[~gone].tobytes()
                n_bytes.append(len(text))
                n_removed.append(int(gone.sum()))
                n_spans.append(len(edge) // 2)
                sha.append(hashlib.sha256(left).hexdigest())
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string()), pa.array(spans, span)],
                names=["rid", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    return run


REMOVED = "rid long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, chunk: int = B.CHUNK) -> DataFrame:
    """Bytes of each text that lie in a `length`-byte string which starts earlier too.

    Earlier: in a row of a smaller id, or in the same row.  One row comes back
    for each row: id, sizes, removed spans as byte offsets, and the hash of what
    is left.  Null texts are empty; shorter texts repeat nothing; other columns
    are not read.  Rows with a null id or an id that occurs again count as rows
    of their own, in the order of id (null first) and a hash of the text; equal
    rows then follow each other and the first keeps its bytes.  An empty table gives none.
    `length` is 4 to 255.  Texts over four times `chunk` bytes are read in slices,
    which changes nothing in the result.
    """
    if not 4 <= length <= 255:
        raise ValueError("length must be 4 to 255")
    spark = docs.sparkSession
    n = B.partitions(spark)
    rows, _ = B.ordered_rows(docs, id_col, text_col)
    found, part = None, length // 4
    while part < length:
        # all joins take the same columns, so they read one exchange of the texts; the hash side holds positions only
        source = rows.select("rid", "text") if found is None else _with_texts(rows, found)
        ranked = source.mapInArrow(B.tidy(_rank(length, part, found is None, n, chunk)), B.BLOB)
        found = B.exchange(B.exchange(ranked, n).mapInArrow(B.tidy(_rerank(n)), B.BLOB), n).mapInArrow(B.tidy(B.by_doc(FOUND)), B.BY_DOC)
        part *= 2
    whole = _with_texts(rows, found).mapInArrow(B.tidy(_rank_whole(length, n, chunk)), B.BLOB)
    later = B.exchange(whole, n).mapInArrow(B.tidy(later_ones(WHOLE, n, True)), B.BLOB)
    done = B.exchange(later, n).mapInArrow(B.tidy(B.by_doc(DONE)), B.BY_DOC)
    return _with_texts(rows, done, "left").mapInArrow(B.tidy(_remove(length)), REMOVED)


def _with_texts(rows: DataFrame, found: DataFrame, how: str = "inner") -> DataFrame:
    return rows.join(found.select("rid", "items").hint("shuffle_hash"), "rid", how).select("rid", "doc_id", "text", "items")
