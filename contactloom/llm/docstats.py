"""Statistics of texts, from flat byte arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from contactloom.llm import blocks as B

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_distinct_words", "n_upper", "n_letters", "n_digits", "n_marks", "n_same_as_last")

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True
_HEAD = (np.arange(256) & 0xC0) != 0x80  # first bytes of code points
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC2, 0xF5)]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b"!\"'()+,-./:;=?@[\\]^_`{}~")] = True


def _per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[at[1:]] - total[at[:-1]]


def _again(value: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether an item equals an earlier one of its row, and whether any other."""
    order = np.lexsort((value, row))
    v, r = value[order], row[order]
    same = np.zeros(len(v), dtype=bool)
    same[1:] = (v[1:] == v[:-1]) & (r[1:] == r[:-1])
    both = same.copy()
    both[:-1] |= same[1:]
    later, other = np.empty_like(same), np.empty_like(same)
    later[order], other[order] = same, both
    return later, other


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS and MORE of each text; null counts as empty.

    n_words: words; word_chars: their code points; n_symbols: characters of
    SYMBOLS; n_dup_lines: lines with a word that equal an earlier line;
    n_repeat_words: words in 5-word windows that occur twice or more in the text.
    """
    chars, grams = B.Poly(14), B.Poly(15)
    out: dict[str, list] = {k: [] for k in (*COUNTS, *MORE)}
    for _, data, at in B.chunks(column):
        n = len(at) - 1
        starts, ends, first = B.split_words(data, at)
        row = B.rows_of(first)
        sums = chars.sums(chars.table[data])
        h = chars.slices(sums, starts, ends)
        got = {"n_words": np.diff(first), "word_chars": _per_row(_HEAD[data] & ~B.SPACE[data], at)}
        for name, table in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_letters", _LETTER), ("n_digits", _DIGIT), ("n_marks", _MARK)):
            got[name] = _per_row(table[data], at)
        # lines: cut at line feeds and at the ends of texts
        feed = np.flatnonzero(data == 10)
        begin = np.union1d(at[:-1][np.diff(at) > 0], feed + 1)
        begin = begin[begin < len(data)]
        owner = np.searchsorted(at, begin, "right") - 1
        stop = np.minimum(np.append(begin[1:], len(data)), at[owner + 1])
        stop = stop - ((stop > begin) & (data[np.maximum(stop - 1, 0)] == 10))
        worded = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
        begin, stop, owner = begin[worded], stop[worded], owner[worded]
        later, _ = _again(chars.slices(sums, begin, stop), owner)
        got["n_lines"] = np.bincount(owner, minlength=n)
        got["n_dup_lines"] = np.bincount(owner[later], minlength=n)
        later, _ = _again(h, row)
        got["n_distinct_words"] = np.bincount(row[~later], minlength=n)
        same = np.zeros(len(h), dtype=bool)
        same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        got["n_same_as_last"] = np.bincount(row[same], minlength=n)
        p = B.fits(first, 5)
        _, other = _again(grams.slices(grams.sums(h), p, p + 5), row[p])
        edge = np.zeros(len(h) + 6, dtype=np.int32)
        np.add.at(edge, p[other], 1)
        np.add.at(edge, p[other] + 5, -1)
        got["n_repeat_words"] = np.bincount(row[np.cumsum(edge)[: len(h)] > 0], minlength=n)
        for k, v in got.items():
            out[k].append(v.astype(np.int64))
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}
