"""Toxicity by a subsequence string kernel and a support vector machine.

The kernel of two words counts their common subsequences of three characters,
each weighted by DECAY to the power of the span it takes in both, normalised; so
gaps and inserted characters cost a little and don't hide a word.  A sentence's
kernel with a landmark is that of its word that is most alike, and the Nyström map
K^-1/2 makes these a vector.  A linear machine is trained on the sentences of
labelled texts: all sentences of clean texts are negative; of a toxic text the
sentence that is now the worst is positive, and so again in rounds.  Landmarks are
words of toxic sentences; what weight they have, if any, the machine finds.  A
text is scored by its worst sentence, and by how many of its sentences are beyond
the margin, put together by a logistic fit on margins of left-out texts.  Kernels
are evaluated only where a word has all but a fifth of a landmark's distinct
characters, and are zero elsewhere.  ASCII punctuation within and beside words is
left out first, and runs of single characters ("i d i o t") are words, too.
"""

from __future__ import annotations

import pickle
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.llm import blocks as B

ORDER, DECAY = 3, 0.75
#: A power of a kernel is one; it sets near misses further apart.
POWER = 2
#: Landmarks at most, how alike two may be, and bytes of a word that are compared at a time.
LANDMARKS, ALIKE, LENGTH = 64, 0.6, 40
#: Labelled rows of each kind that are learned from at most, those of the least hash of the id.
SAMPLE = 2000
#: Words whose kernels a worker remembers at a time, and those of them that have any.
MEMORY, LIVE = 1_000_000, 100_000
#: Words of a sentence at most; longer ones are cut.
SENTENCE = 48
#: Clean texts for each toxic one that the logistic fit reckons with, whatever the sample holds.
CLEAN = 4


def _table(words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
    return flat, n


def _subsequences(s: np.ndarray, t: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Kernel of each row of s with the same row of t; zero bytes match nothing."""
    n, a, b = len(s), s.shape[1], t.shape[1]
    d2 = decay * decay
    same = (s[:, :, None] == t[:, None, :]) & (s[:, :, None] != 0)
    k = np.ones((n, a + 1, b + 1))
    for level in range(order):
        if level == order - 1:
            return (same * k[:, :a, :b]).sum(axis=(1, 2)) * d2
        new = np.zeros((n, a + 1, b + 1))
        for i in range(1, a + 1):
            part = np.zeros(n)
            for j in range(1, b + 1):
                part = decay * part + d2 * (same[:, i - 1, j - 1] * k[:, i - 1, j - 1])
                new[:, i, j] = decay * new[:, i - 1, j] + part
        k = new
    return k[:, 0, 0]


def _letters(flat: np.ndarray) -> np.ndarray:
    """Sets of a word's bytes, as 64 bits by a fixed hash."""
    bits = np.left_shift(np.uint64(1), (np.arange(256, dtype=np.uint64) * np.uint64(37)) % np.uint64(64))
    bits[0] = 0
    return np.bitwise_or.reduce(bits[flat], axis=1)


def _self(flat: np.ndarray, size: int = 2000) -> np.ndarray:
    out = [_subsequences(flat[i : i + size], flat[i : i + size]) for i in range(0, len(flat), size)]
    return np.concatenate(out) if out else np.zeros(0)


def _squeeze(flat: np.ndarray, n: np.ndarray) -> np.ndarray:
    return flat[:, : max(1, int(n.max(initial=1)))]


@dataclass
class Landmarks:
    words: list[bytes]
    map: np.ndarray | None = None
    flat: np.ndarray = field(init=False)
    own: np.ndarray = field(init=False)

    def __post_init__(self):
        flat, n = _table(self.words, LENGTH)
        self.flat = _squeeze(flat, n)
        self.size = n
        self.letters = _letters(self.flat)
        self.need = np.ceil(0.8 * np.array([bin(x).count("1") for x in self.letters.tolist()])).astype(np.int64)
        self.own = _self(self.flat)
        if self.map is None:
            k = self.kernel(self.words).astype(float)
            k = (k + k.T) / 2
            value, vector = np.linalg.eigh(k)
            keep = value > 1e-3
            self.map = vector[:, keep] / np.sqrt(value[keep])

    def kernel(self, words: list[bytes], size: int = 20_000) -> np.ndarray:
        """Normalised kernels, a row for each word; longer words by their best slice."""
        parts = [self._kernel(words[i : i + size]) for i in range(0, len(words), size)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.words)), np.float32)

    def _kernel(self, words: list[bytes]) -> np.ndarray:
        cut, owner = [], []
        for i, w in enumerate(words):
            for a in range(0, max(1, len(w) - LENGTH // 2), LENGTH // 2):
                cut.append(w[a : a + LENGTH])
                owner.append(i)
        flat, n = _table(cut, LENGTH)
        letters, owner = _letters(flat), np.array(owner)
        out = np.zeros((len(words), len(self.words)), np.float32)
        own = np.zeros(len(cut))
        known = np.zeros(len(cut), dtype=bool)
        for m in range(len(self.words)):
            common = np.bitwise_count(letters & self.letters[m])
            hit = np.flatnonzero((common >= self.need[m]) & (n >= ORDER))
            for i in range(0, len(hit), 2000):
                h = hit[i : i + 2000]
                new = h[~known[h]]
                if len(new):
                    own[new] = _self(_squeeze(flat[new], n[new]))
                    known[new] = True
                t = np.broadcast_to(self.flat[m, : self.size[m]], (len(h), self.size[m]))
                k = _subsequences(_squeeze(flat[h], n[h]), t) / np.sqrt(np.maximum(own[h] * self.own[m], 1e-12))
                np.maximum.at(out[:, m], owner[h], (k**POWER).astype(np.float32))
        return out

    def vectors(self, words: list[bytes]) -> np.ndarray:
        return self.kernel(words) @ self.map


_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


_HEAD = (np.arange(256) & 0xC0) != 0x80  # first bytes of code points
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?")] = True


def candidates(data: np.ndarray, at: np.ndarray):
    """Bytes without punctuation, and (starts, ends, row, sentence) in them of the words and
    of the runs of single characters of a chunk; sentences are numbered through the chunk.

    A sentence ends at a line feed, or at a full stop, exclamation or question mark
    before white space, or after SENTENCE words.
    """
    data = B.LOWER[data]
    starts, ends, first = B.split_words(data, at)
    row = B.rows_of(first)
    stop = _STOP[data] & np.append(B.SPACE[data[1:]], True) if len(data) else _STOP[data]
    stop = np.concatenate(([0], np.cumsum(stop | (data == 10))))
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (stop[starts[1:]] != stop[starts[:-1]])
    place = np.arange(len(starts)) - (np.flatnonzero(new)[np.cumsum(new) - 1] if len(starts) else 0)
    sentence = np.cumsum(new | (place % SENTENCE == 0)) - 1
    keep = ~_PUNCTUATION[data]
    place = np.concatenate(([0], np.cumsum(keep)))
    starts, ends = place[starts], place[ends]
    some = ends > starts
    starts, ends, row, sentence = starts[some], ends[some], row[some], sentence[some]
    # without the spaces, words of one run lie side by side
    solid = keep & ~B.SPACE[data]
    if not len(starts):
        return data[solid], starts, ends, row, sentence
    shift = np.concatenate(([0], np.cumsum(solid[keep])))
    starts, ends = shift[starts], shift[ends]
    data = data[solid]
    chars = np.concatenate(([0], np.cumsum(_HEAD[data])))
    one = chars[ends] - chars[starts] == 1
    joined = one.copy()
    joined[1:] &= one[:-1] & (row[1:] == row[:-1])
    joined[0] = False
    begin = np.flatnonzero(one & ~joined)
    after = np.append(np.flatnonzero(~joined), len(starts))
    end = after[np.searchsorted(after, begin, "right")]
    long = end - begin >= ORDER
    begin, end = begin[long], end[long] - 1
    return data, np.concatenate((starts, starts[begin])), np.concatenate((ends, ends[end])), np.concatenate((row, row[begin])), np.concatenate((sentence, sentence[begin]))


def _words_of(text: bytes) -> tuple[list[bytes], np.ndarray]:
    raw, s, e, _, sentence = candidates(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    raw = raw.tobytes()
    return [raw[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)], sentence


def _pooled(kernel: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest kernels of each sentence, and the sentences; rows are those of their words."""
    order = np.argsort(sentence, kind="stable")
    s = sentence[order]
    cut = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
    return (np.maximum.reduceat(kernel[order], cut, axis=0) if len(s) else kernel), s[cut]


@dataclass
class Model:
    landmarks: list[bytes]
    map: np.ndarray
    weights: np.ndarray
    bias: float
    #: Of a constant, the worst margin, and how many sentences are beyond the margin of all there are.
    logistic: np.ndarray

    def probability(self, worst: np.ndarray, beyond: np.ndarray, number: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_facts(worst, beyond, number) @ self.logistic, -40, 40)))


def _facts(worst: np.ndarray, beyond: np.ndarray, number: np.ndarray) -> np.ndarray:
    """What is known of texts: worst margin, sentences beyond the margin, sentences."""
    return np.stack((np.ones(len(worst)), np.clip(worst, -4, 4), np.log1p(beyond), np.log1p(beyond) - np.log1p(number)), axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Penalised logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    lam = np.full(len(w), 1e-3)
    lam[0] = 0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (cost * (p - y)) + lam * w
        h = (x * (cost * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(lam + 1e-9)
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
    return w


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 400) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by Nesterov's method."""
    x1 = np.concatenate((x, np.ones((len(x), 1), x.dtype)), axis=1)
    w = v = np.zeros(x1.shape[1])
    rate = 1 / (1 + 2 * (cost * np.einsum("ij,ij->i", x1, x1)).sum())
    lam = np.full(x1.shape[1], 1e-3)
    lam[-1] = 0
    t = 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x1 @ v.astype(x1.dtype)))
        g = lam * v - 2 * (x1.T @ (cost * y * slack).astype(x1.dtype))
        new = v - rate * g
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w[:-1], float(w[-1])


def _varied(word: bytes) -> list[bytes]:
    """A word with a character put in, doubled, or left out."""
    return [word[:k] + x + word[k:] for k in (1, 2, len(word) // 2) for x in (b"x", b"1")] + [word[:k] + word[k - 1 : k] + word[k:] for k in (1, 2, len(word))] + [word[:2] + word[3:]] * (len(word) > 5)


def _landmarks(words: list[bytes]) -> list[bytes]:
    """The first LANDMARKS words of which no two are too alike."""
    every = Landmarks(words[: 8 * LANDMARKS], np.zeros((min(len(words), 8 * LANDMARKS), 1)))
    k, taken = every.kernel(every.words), []
    for i in range(len(every.words)):
        if len(taken) < LANDMARKS and (not taken or max(k[i, taken].max(), k[taken, i].max()) < ALIKE):
            taken.append(i)
    return [every.words[i] for i in taken]


def fit(toxic: list[bytes], clean: list[bytes]) -> Model | None:
    """A model of labelled texts; None if there aren't both kinds, or nothing sets them apart.

    Landmarks are proposed in the order of their log odds of occurring in toxic texts.
    """
    if not toxic or not clean:
        return None
    number: dict[bytes, int] = {}
    words_of = [_words_of(t) for t in (*toxic, *clean)]
    texts = [np.array([number.setdefault(w, len(number)) for w in ws], np.int64) for ws, _ in words_of]
    sentences = [s for _, s in words_of]
    del words_of
    words = list(number)
    v, nb, nc = len(words), len(toxic), len(clean)
    a, b = (np.bincount(np.concatenate([np.unique(t) for t in some] or [np.zeros(0, np.int64)]), minlength=v) for some in (texts[:nb], texts[nb:]))
    odds = np.log((a + 0.5) / (b * nb / nc + 0.5))
    length = np.array([len(w) for w in words])
    marked = np.flatnonzero((odds > 1.0) & (length >= ORDER) & (a >= max(2, 0.002 * nb)))
    # likely by chance: a word that is rare in toxic texts and hardly more frequent there
    marked = marked[(a[marked] - b[marked] * nb / nc) ** 2 > 2.5 * np.maximum(a[marked], 1)]
    if not len(marked):
        return None
    order = sorted(marked.tolist(), key=lambda i: (-odds[i] * np.log1p(a[i]), words[i]))
    marks = Landmarks(_landmarks([words[i] for i in order]))
    # kernels of the words that have any
    rows, place = [], np.full(v, -1, np.int64)
    for c in range(0, v, 20_000):
        k = marks.kernel(words[c : c + 20_000])
        live = np.flatnonzero(k.any(axis=1))
        place[c + live] = sum(map(len, rows)) + np.arange(len(live))
        rows.append(k[live])
    kernel = np.concatenate(rows)
    # the sentences that have such words
    pools, owner, size = [], [], np.array([len(np.unique(s)) for s in sentences])
    for i, (t, s) in enumerate(zip(texts, sentences, strict=True)):
        at = place[t]
        pool, _ = _pooled(kernel[at[at >= 0]], s[at >= 0])
        pools.append(pool)
        owner.append(np.full(len(pool), i))
    x, owner = np.concatenate(pools) @ marks.map, np.concatenate(owner)
    x = x.astype(np.float32)
    truth = np.arange(nb + nc) < nb
    fold = np.arange(nb + nc) % 3

    def per_text(score: np.ndarray, bias: float):
        worst, beyond = np.full(nb + nc, bias), np.zeros(nb + nc)
        np.maximum.at(worst, owner, score)
        np.add.at(beyond, owner, score > 0)
        return worst, beyond

    def worst_of(score: np.ndarray, some: np.ndarray) -> np.ndarray:
        """The worst sentence of each of some texts."""
        by = np.lexsort((-score, owner))
        by = by[some[owner[by]]]
        return by[np.concatenate(([True], owner[by][1:] != owner[by][:-1]))] if len(by) else by

    def varied(at: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Vectors of the worst words of some sentences' texts, with a character more or less."""
        score = kernel @ (marks.map @ w)
        found = set()
        for i in np.unique(owner[at]).tolist():
            t = texts[i][place[texts[i]] >= 0]
            found.add(words[t[np.argmax(score[place[t]])]])
        return marks.vectors(sorted({u for f in found for u in _varied(f)})).astype(np.float32)

    def machine(inside: np.ndarray, rounds: int = 3):
        """Trained on the texts inside."""
        own = inside[owner]
        up, down = np.flatnonzero(own & truth[owner]), np.flatnonzero(own & ~truth[owner])
        share = 1 / np.bincount(owner, minlength=nb + nc)[owner[up]] if len(up) else np.zeros(0)
        more, hard, zero = np.zeros((0, x.shape[1]), np.float32), down[:0], np.zeros((1, x.shape[1]), np.float32)
        for _ in range(rounds):
            data = np.concatenate((x[up], more, x[down], x[hard], zero))
            y = np.concatenate((np.ones(len(up) + len(more)), -np.ones(len(down) + len(hard) + 1)))
            each = [(share, 4.0), (np.ones(len(more)), 0.5), (np.ones(len(down)), 1.0), (np.ones(len(hard)), 1.0), (np.ones(1), 1.0)]
            cost = np.concatenate([c * (t / c.sum() if len(c) else 0) for c, t in each])
            w, bias = _machine(data, y, cost)
            score = x @ w + bias
            up, hard = worst_of(score, inside & truth), worst_of(score, inside & ~truth)
            share, more = np.ones(len(up)), varied(up, w) if len(up) else more
        return w, bias, score

    facts = np.zeros((nb + nc, 4))
    for f in range(3):
        out = fold == f
        if not truth[~out].any():
            return None
        _, bias, score = machine(~out)
        worst, beyond = per_text(score, bias)
        facts[out] = _facts(worst, beyond, size)[out]
    w, bias, _ = machine(np.ones(nb + nc, dtype=bool))
    cost = np.where(truth, 1.0, CLEAN * nb / nc)
    return Model(marks.words, marks.map, w, float(bias), _logistic(facts, truth.astype(float), cost))


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model | None:
    """Fit on at most `sample` labelled rows of each kind whose crc32(id) mod 5 isn't 0."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter("doc_id is not null and toxic is not null").filter(crc % 5 != 0).dropDuplicates(["doc_id"])
    known = known.withColumn("h", F.xxhash64("doc_id"))
    some = known.filter("toxic = 1").orderBy("h").limit(sample).union(known.filter("toxic = 0").orderBy("h").limit(sample))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    got = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).join(some, "doc_id")
    got = got.dropDuplicates(["doc_id"]).orderBy("h").limit(2 * sample).select("h", "toxic", "text")

    def run(batches):
        rows = sorted((h, t, x) for batch in batches for h, t, x in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        toxic, clean = ([x.encode() for _, t, x in rows if t == k] for k in (1, 0))
        del rows
        model = fit(toxic, clean)
        yield pa.RecordBatch.from_arrays([pa.array([] if model is None else [pickle.dumps(model)], pa.binary())], names=["model"])

    # the sample is bounded, so one task fits the model, and the driver holds no texts
    found = got.mapInArrow(B.tidy(run), "model binary").collect()
    return pickle.loads(bytes(found[0].model)) if found else None


class Scorer:
    """Scores columns of texts; remembers the kernels of words."""

    #: Bytes of text whose words are held at a time.
    HELD = 4 << 20

    def __init__(self, model: Model | None):
        self.model = model
        if model is not None:
            self.marks, self.poly = Landmarks(model.landmarks, model.map), B.Poly(17)
            self.weights = model.map @ model.weights
            self._forget()

    def _forget(self) -> None:
        """Of a word: its hash, and the row of its kernels, -1 if it has none."""
        self.known, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.kernel = np.zeros((0, len(self.marks.words)), np.float32)

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        if self.model is None:
            return out
        parts, fresh, held = [], {}, 0
        for i, data, at in B.chunks(column):
            rows, size = len(at) - 1, len(data)
            data, s, e, row, sentence = candidates(data, at)
            h = self.poly.slices(self.poly.sums(self.poly.table[data]), s, e)
            u, first, back = np.unique(h, return_index=True, return_inverse=True)
            place = np.minimum(np.searchsorted(self.known, u), max(0, len(self.known) - 1))
            new = self.known[place] != u if len(self.known) else np.ones(len(u), dtype=bool)
            raw, f = data.tobytes(), first[new]
            for k, a, b in zip(u[new].tolist(), s[f].tolist(), e[f].tolist(), strict=True):
                if k not in fresh:
                    fresh[k] = raw[a:b]
            parts.append((i, rows, u, back.astype(np.int32), row.astype(np.int32), sentence.astype(np.int32)))
            held += size
            if held >= self.HELD:
                self._flush(parts, fresh, out)
                parts, fresh, held = [], {}, 0
        self._flush(parts, fresh, out)
        return out

    def _flush(self, parts: list, fresh: dict, out: np.ndarray) -> None:
        if len(self.known) > MEMORY or len(self.kernel) > LIVE:
            used = np.isin(self.known, np.concatenate([p[2] for p in parts])) if parts else np.zeros(len(self.known), dtype=bool)
            self.known, self.row = self.known[used], self.row[used]
            live = self.row >= 0
            self.kernel = self.kernel[self.row[live]]
            self.row[live] = np.arange(len(self.kernel))
        if fresh:
            k = self.marks.kernel(list(fresh.values()))
            live = k.any(axis=1)
            row = np.where(live, len(self.kernel) + np.cumsum(live) - 1, -1)
            self.kernel = np.concatenate((self.kernel, k[live]))
            h, row = np.concatenate((self.known, np.fromiter(fresh, np.uint64, len(fresh)))), np.concatenate((self.row, row))
            order = np.argsort(h, kind="stable")
            self.known, self.row = h[order], row[order]
        for i, rows, u, back, row, sentence in parts:
            worst, beyond, number = np.full(rows, self.model.bias), np.zeros(rows), np.zeros(rows)
            if len(u):
                at = self.row[np.searchsorted(self.known, u)][back]
                first = np.unique(sentence, return_index=True)[1]
                number = np.bincount(row[first], minlength=rows)
                owner = row[first]
                pool, own = _pooled(self.kernel[at[at >= 0]], sentence[at >= 0])
                score = pool @ self.weights + self.model.bias
                # sentences are numbered through, but words without punctuation may leave some out
                owner = owner[np.searchsorted(np.sort(sentence[first]), own)]
                np.maximum.at(worst, owner, score)
                np.add.at(beyond, owner, score > 0)
            out[i : i + rows] = self.model.probability(worst, beyond, number)


_SCORERS: dict[bytes, Scorer] = {}


def scorer_of(packed: bytes) -> Scorer:
    """The worker's scorer of a model, kept from task to task with the words that it knows."""
    if packed not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[packed] = Scorer(pickle.loads(packed))
    return _SCORERS[packed]


def score_texts(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= 0.5) of each row.

    A text is scored by its worst sentence and the share of such ones, whole
    however long; empty and null texts get the score of a text without any.  One row for each row, repeated and null ids included (a
    null id is not held out); other columns are not read.  Without a model
    nothing is known to be toxic: the score is 0.
    """

    packed = pickle.dumps(model)

    def run(batches):
        scorer = scorer_of(packed)
        for batch in batches:
            score = scorer.scores(batch.column(1))
            ids = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x is not None and held_out(x) for x in ids], pa.bool_()), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(B.tidy(run), "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows that aren't predicted to be toxic, all columns as they are; nothing is shuffled."""
    at = docs.columns.index(text_col)

    packed = pickle.dumps(model)

    def run(batches):
        scorer = scorer_of(packed)
        for batch in batches:
            yield batch.filter(pa.array(scorer.scores(batch.column(at)) < 0.5))

    return docs.mapInArrow(B.tidy(run), docs.schema)
