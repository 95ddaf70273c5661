"""Repeated word sequences by difference-cover anchors.

The residues D = {0, 1, 3, 9} modulo 13 are a difference cover: for any two
positions some shift below 13 moves both onto D.  So of two equal windows of 20
words, wherever they start, a pair of 8-word anchors at the same shift lies on
cover positions in both; only 4 of 13 positions are hashed.  An anchor that no
other cover position has is dropped.  Windows that hold an anchor which is left
are extended to their whole length: hashed in full, compared, and all but the
first are repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.llm import blocks as B
from contactloom.llm.suffix_dedup import _covered, later_ones

ANCHOR = ("h6", "doc", "pos")
#: hash of a window in two parts, document, first word
WINDOW = ("<u8", "<u4", "doc", "pos")
#: A perfect difference set.
PERIOD, COVER = 13, (0, 1, 3, 9)


def _word_hashes(data: np.ndarray, at: np.ndarray, poly: B.Poly):
    starts, ends, first = B.split_words(data, at)
    return poly.slices(poly.sums(poly.table[data]), starts, ends), first, starts, ends


def _anchors(length: int, n: int):
    def run(batches):
        chars, grams = B.Poly(5), B.Poly(6)
        size = length - PERIOD + 1
        on = np.zeros(PERIOD, dtype=bool)
        on[list(COVER)] = True
        for batch in batches:
            rid, got = batch.column(0).to_numpy(), []
            for i, data, at in B.chunks(batch.column(1)):
                h, first, _, _ = _word_hashes(data, at, chars)
                p = B.fits(first, size)
                row = B.rows_of(first)
                place = p - first[row[p]]
                take = on[place % PERIOD]
                p, place = p[take], place[take]
                got.append((grams.slices(grams.sums(h), p, p + size), rid[row[p] + i], place))
            rows: list = []
            if got:
                h, doc, place = (np.concatenate(c) for c in zip(*got, strict=True))
                h &= ~np.uint64(0xFFFF)
                # of one anchor a batch sends two places at most: enough to show that it repeats
                order = np.argsort(h, kind="stable")
                k = h[order]
                third = np.zeros(len(k), dtype=bool)
                third[2:] = k[2:] == k[:-2]
                rest, keep = np.sort(order[third]), np.sort(order[~third])
                B.deal(B.bucket_of(h[keep], n), 0, ANCHOR, (h[keep], doc[keep], place[keep]), rows)
                B.deal(B.doc_bucket(doc[rest], n), 1, ANCHOR[1:], (doc[rest], place[rest]), rows)
            yield B.blob_batch(rows)

    return run


def _shared(n: int):
    """Anchors that occur more than once, dealt by document."""

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
        h, doc, place = B.unpack_all(ANCHOR, blobs)
        order = np.argsort(h, kind="stable")
        k = h[order]
        same = k[1:] == k[:-1]
        more = np.zeros(len(k), dtype=bool)
        more[1:] |= same
        more[:-1] |= same
        own = np.sort(order[more])
        B.deal(B.doc_bucket(doc[own], n), 1, ANCHOR[1:], (doc[own], place[own]), rows)
        yield B.blob_batch(rows)

    return run


def _extend(length: int, n: int):
    def run(batches):
        chars, one, two = B.Poly(5), B.Poly(7), B.Poly(8)
        reach = PERIOD - 1
        for batch in batches:
            rid, got = batch.column(0).to_numpy(), []
            marks = [B.unpack(("pos",), x.as_buffer())[0] for x in batch.column(3)]
            for i, data, at in B.chunks(batch.column(2)):
                h, first, _, _ = _word_hashes(data, at, chars)
                hit = np.concatenate([marks[i + r] + first[r] for r in range(len(at) - 1)])
                edge = np.zeros(len(h) + 2, dtype=np.int32)
                np.add.at(edge, np.maximum(hit - reach, 0), 1)
                np.add.at(edge, hit + 1, -1)
                p = B.fits(first, length)
                p = p[np.cumsum(edge)[p] > 0]
                if len(p):
                    row = B.rows_of(first)[p]
                    a, b = (g.slices(g.sums(h), p, p + length) for g in (one, two))
                    got.append((a, (b >> np.uint64(32)).astype(np.uint32), rid[row + i], p - first[row]))
            rows: list = []
            if got:
                a, b, doc, place = (np.concatenate(c) for c in zip(*got, strict=True))
                order = np.lexsort((place, doc, b, a))
                again = np.zeros(len(a), dtype=bool)
                again[1:] = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
                keep, rest = np.sort(order[~again]), np.sort(order[again])
                B.deal(B.bucket_of(a[keep], n), 0, WINDOW, (a[keep], b[keep], doc[keep], place[keep]), rows)
                B.deal(B.doc_bucket(doc[rest], n), 1, ("doc", "pos"), (doc[rest], place[rest]), rows)
            yield B.blob_batch(rows)

    return run


def _remove(length: int):
    def run(batches):
        for batch in batches:
            n_words, n_removed, sha, kept = [], [], [], []
            for i, data, at in B.chunks(batch.column(2)):
                starts, ends, first = B.split_words(data, at)
                for r in range(len(at) - 1):
                    s, e = starts[first[r] : first[r + 1]], ends[first[r] : first[r + 1]]
                    hit = batch.column(3)[i + r]
                    gone = np.zeros(len(s), dtype=bool)
                    if hit.is_valid:
                        (p,) = B.unpack(("pos",), hit.as_buffer())
                        gone = _covered(p, np.ones(len(p), np.int64), length - 1, len(s))
                    text = data[at[r] : at[r + 1]].tobytes().split()
                    left = b" ".join([w for w, g in zip(text, gone.tolist(), strict=True) if not g] if gone.any() else text)
                    n_words.append(len(s))
                    n_removed.append(int(gone.sum()))
                    sha.append(hashlib.sha256(left).hexdigest())
                    kept.append(left.decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())],
                names=["rid", "doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return run


REMOVED = "rid long, doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 20) -> DataFrame:
    """Words of each text that lie in a window of `length` words which starts earlier too.

    Earlier: in a row of a smaller id, or in the same row.  Words are runs of
    other characters than space and the controls 9 to 13.  One row comes back
    for each row, with the counts, the text of the words that are left, joined
    by one space, and its hash.  Null texts have no words; shorter texts repeat
    nothing; other columns are not read.  Rows with a null id or an id that
    occurs again count as rows of their own, in the order of id (null first)
    and a hash of the text.  An empty table gives none.  `length` is 14 or more.
    """
    if length < PERIOD + 1:
        raise ValueError(f"length must be {PERIOD + 1} or more")
    n = B.partitions(docs.sparkSession)
    rows, _ = B.ordered_rows(docs, id_col, text_col)
    shared = B.exchange(rows.select("rid", "text").mapInArrow(_anchors(length, n), B.BLOB), n).mapInArrow(_shared(n), B.BLOB)
    marks = B.exchange(shared, n).mapInArrow(B.by_doc(("doc", "pos")), B.BY_DOC).select("rid", "items")
    # both joins take the same columns, so they read one exchange of the texts; the hash side holds positions only
    windows = rows.join(marks.hint("shuffle_hash"), "rid").select("rid", "doc_id", "text", "items").mapInArrow(_extend(length, n), B.BLOB)
    later = B.exchange(windows, n).mapInArrow(later_ones(WINDOW, n), B.BLOB)
    again = B.exchange(later, n).mapInArrow(B.by_doc(("doc", "pos")), B.BY_DOC).select("rid", F.col("items").alias("again"))
    all_ = rows.join(again.hint("shuffle_hash"), "rid", "left")
    return all_.select("rid", "doc_id", "text", "again").mapInArrow(_remove(length), REMOVED)
