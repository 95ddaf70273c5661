"""Ordinal cumulative-link regression over hashed text.

P(grade <= k) = logistic(threshold_k - x . w): one set of weights shared by all
grades and ordered thresholds.  x holds the shares of hashed byte 3-grams and of
hashed word shapes of a text, so a text is scored by looking up a weight for
each and averaging, in one pass and with no matrix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.llm import blocks as B

#: Hashed features of each kind.
SIZE = 2048
#: Labelled rows that are learned from at most, those of the least hash of the id.
SAMPLE = 6000
STEPS, RATE, DECAY = 250, 0.05, 1e-3

_CLASS = np.zeros(256, dtype=np.uint64)  # other bytes stand for themselves
_CLASS[:] = np.arange(256)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[0x80:] = 65, 97, 48, 97


def _tokens(data: np.ndarray, at: np.ndarray):
    """(feature, row) of the 3-grams, and of the word shapes, of a chunk."""
    flat = data.astype(np.uint64)
    flat[(data >= 48) & (data < 58)] = 48
    n = len(data)
    p = B.fits(at, 3)
    size = np.diff(at)
    owner = np.repeat(np.arange(len(at) - 1), size)
    g = (flat[p] << np.uint64(16)) | (flat[p + 1] << np.uint64(8)) | flat[p + 2] if n else p.astype(np.uint64)
    gram = (B.mix(g + np.uint64(1)) % np.uint64(SIZE)).astype(np.int64)
    starts, ends, first = B.split_words(data, at)
    row = B.rows_of(first)
    length = np.minimum(ends - starts, 12).astype(np.uint64)
    poly = B.Poly(16)
    h = poly.slices(poly.sums(poly.table[data]), starts, ends)
    last = np.zeros(len(h), np.uint64)
    last[1:] = ((h[1:] == h[:-1]) & (row[1:] == row[:-1])).astype(np.uint64)
    kind = _CLASS[data]
    begin = kind[starts] if len(starts) else np.zeros(0, np.uint64)
    end = kind[ends - 1] if len(starts) else begin
    inner = kind[np.minimum(starts + 1, ends - 1)] if len(starts) else begin
    s = begin | (inner << np.uint64(8)) | (end << np.uint64(16)) | (last << np.uint64(24)) | (length << np.uint64(32))
    shape = SIZE + (B.mix(s + np.uint64(7)) % np.uint64(SIZE)).astype(np.int64)
    # how often a word has come before in its text, by powers of two
    order = np.lexsort((h, row))
    hh, rr = h[order], row[order]
    new = np.ones(len(hh), dtype=bool)
    new[1:] = (hh[1:] != hh[:-1]) | (rr[1:] != rr[:-1])
    place = np.arange(len(hh)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(hh) else np.zeros(0, np.int64)
    seen = np.empty(len(hh), np.int64)
    seen[order] = np.minimum(np.log2(place + 1).astype(np.int64), 9)
    return (gram, owner[p]), (shape, row), (2 * SIZE + seen, row)


WIDTH = 2 * SIZE + 10


def _few(column: pa.Array, most: int):
    """Chunks of a column of `most` rows at most, for dense tables."""
    for i in range(0, len(column), most):
        for j, data, at in B.chunks(column.slice(i, most)):
            yield i + j, data, at


def vectors(column: pa.Array) -> np.ndarray:
    """Shares of the features, a row for each text; zeros for an empty one."""
    out = np.zeros((len(column), WIDTH), np.float32)
    for i, data, at in _few(column, 256):
        n = len(at) - 1
        for f, row in _tokens(data, at):
            count = np.bincount(row, minlength=n)
            x = np.bincount(row * WIDTH + f, minlength=n * WIDTH).reshape(n, WIDTH)
            out[i : i + n] += x / np.maximum(count, 1)[:, None]
    return out


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    @property
    def grades(self) -> int:
        return len(self.thresholds) + 1

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.. for each x . w."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -40, 40)))

    def scores(self, column: pa.Array) -> np.ndarray:
        """x . w of each text."""
        out = []
        for _, data, at in B.chunks(column):
            z = np.zeros(len(at) - 1)
            for f, row in _tokens(data, at):
                count = np.bincount(row, minlength=len(z))
                z += np.bincount(row, weights=self.weights[f], minlength=len(z)) / np.maximum(count, 1)
            out.append(z)
        return np.concatenate(out) if out else np.zeros(0)


def fit(x: np.ndarray, grade: np.ndarray, grades: int) -> Model:
    """Weights and ordered thresholds of the largest penalised likelihood (Adam)."""
    scale = x.std(axis=0)
    scale = np.where(scale > 1e-6, 1 / np.maximum(scale, 1e-6), 0).astype(np.float32)
    scale = np.minimum(scale, 2000)
    mean = x.mean(axis=0)
    u = (x - mean) * scale
    n, d = u.shape
    w = np.zeros(d, np.float32)
    share = np.cumsum([(grade == k).mean() for k in range(grades)])[:-1]
    cut = np.log((share + 1e-3) / (1 - share + 1e-3))
    # thresholds as a first one and positive gaps stay in order
    t = np.concatenate((cut[:1], np.log(np.maximum(np.diff(cut), 0.05))))
    state = [np.zeros(d), np.zeros(d), np.zeros_like(t), np.zeros_like(t)]
    for step in range(1, STEPS + 1):
        theta = np.concatenate((t[:1], t[0] + np.cumsum(np.exp(t[1:]))))
        z = u @ w
        edge = np.concatenate((np.full((n, 1), -40.0), np.clip(theta[None, :] - z[:, None], -40, 40), np.full((n, 1), 40.0)), axis=1)
        s = 1 / (1 + np.exp(-edge))
        lo, hi = s[np.arange(n), grade], s[np.arange(n), grade + 1]
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        gw = (u.T @ ((dhi - dlo) / n).astype(np.float32)) + DECAY * w
        gtheta = np.array([-(dhi[grade == k].sum() - dlo[grade == k + 1].sum()) / n for k in range(grades - 1)])
        gt = np.concatenate(([gtheta.sum()], [gtheta[k:].sum() * np.exp(t[k]) for k in range(1, grades - 1)]))
        for i, (v, g) in enumerate(((w, gw), (t, gt))):
            m, q = state[2 * i], state[2 * i + 1]
            m += 0.1 * (g - m)
            q += 0.01 * (g * g - q)
            v -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-8)).astype(v.dtype)
    theta = np.concatenate((t[:1], t[0] + np.cumsum(np.exp(t[1:]))))
    own = (w * scale).astype(float)
    return Model(own, theta + float(mean @ own))


def _sampled(batches):
    for batch in batches:
        x = vectors(batch.column(1))
        at, flat = np.nonzero(x), x[x != 0]
        cut = np.searchsorted(at[0], np.arange(len(batch) + 1))
        cells = [at[1][a:b].astype("<u2").tobytes() + flat[a:b].astype("<f4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(cells, pa.binary())], names=["h", "grade", "x"])


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model | None:
    """Fit on at most `sample` rated rows; None if all have one grade.

    `ratings` has doc_id and grade, 0 and up; grades that don't occur are closed up.
    """
    known = ratings.filter("doc_id is not null and grade is not null").dropDuplicates(["doc_id"])
    known = known.withColumn("h", F.xxhash64("doc_id")).orderBy("h").limit(sample)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).join(known, "doc_id")
    rows = rows.select("h", "text", "grade").mapInArrow(_sampled, "h long, grade int, x binary")
    got = rows.dropDuplicates(["h"]).orderBy("h").limit(sample).collect()
    if len({r.grade for r in got}) < 2:
        return None
    x = np.zeros((len(got), WIDTH), np.float32)
    for i, r in enumerate(got):
        k = len(r.x) // 6
        x[i, np.frombuffer(r.x, "<u2", k)] = np.frombuffer(r.x, "<f4", k, 2 * k)
    values, grade = np.unique([r.grade for r in got], return_inverse=True)
    return fit(x, grade, len(values))


def grade_texts(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_grade (0 to the number of grades less 1), tails (P(grade >= k)) and kept.

    kept: the lowest grade is the less likely side.  Null texts are empty; a text
    without words gets the thresholds' own probabilities.  One row for each row;
    other columns are not read.  Without a model nothing is known: grade null, kept.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        return base.select("doc_id", F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("array<double>").alias("tails"), F.lit(True).alias("kept"))

    def run(batches):
        for batch in batches:
            tails = model.tails(model.scores(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tails.sum(axis=1)), pa.array(tails.tolist(), pa.list_(pa.float64())), pa.array(tails[:, 0] >= 0.5)],
                names=["doc_id", "expected_grade", "tails", "kept"],
            )

    return base.mapInArrow(run, "doc_id long, expected_grade double, tails array<double>, kept boolean")
