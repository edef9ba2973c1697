"""Statistics of whole texts, from the flat byte kernels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from archgraph.llm.text import Words, texts

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = _UPPER.copy()
_ALPHA[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".?!"]] = True
_WHITE = " \t\n\v\f\r"
SHINGLE = 3


def repeated(grams: np.ndarray, bounds: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """For each row, how many words lie in windows of k words that the row has more than once."""
    out = np.zeros(len(bounds) - 1, np.int64)
    for r in range(len(out)):
        g = grams[bounds[r] : bounds[r + 1]]
        s = np.sort(g)
        twice = s[1:][s[1:] == s[:-1]]
        if len(twice):
            cover = np.zeros(len(g) + k, np.int32)
            at = np.flatnonzero(np.isin(g, twice))
            np.add.at(cover, at, 1)
            np.add.at(cover, at + k, -1)
            out[r] = int((np.cumsum(cover) > 0).sum())
    return out


def solid_lines(text: str) -> list[str]:
    return [x for x in text.split("\n") if x.strip(_WHITE)]


def measure(column: pa.Array) -> tuple[Words, dict[str, np.ndarray]]:
    """The words of a chunk and, by row: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and more."""
    words = Words(column)
    n = np.diff(words.row_at)
    lines, dups = [], []
    for t in texts(column):
        own = solid_lines(t)
        lines.append(len(own))
        dups.append(len(own) - len(set(own)))
    h, row = words.h, words.row
    same = np.zeros(words.n, bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    buf = words.buf
    last = buf[words.end - 1] if words.n else np.zeros(0, np.uint8)
    by_row = lambda mask: np.bincount(row[mask], minlength=words.rows)
    size = words.end - words.start
    first = buf[words.start] if words.n else last
    second = buf[np.minimum(words.start + 1, max(len(buf) - 1, 0))] if words.n else last
    return words, {
        "n_words": n,
        "word_chars": words.per_row(words.solid & ((buf & 0xC0) != 0x80)),
        "n_symbols": words.per_row(_SYMBOL[buf]),
        "n_lines": np.array(lines, np.int64),
        "n_dup_lines": np.array(dups, np.int64),
        "n_repeat_words": repeated(*words.windows(SHINGLE)),
        "n_upper": words.per_row(_UPPER[buf]),
        "n_alpha": words.per_row(_ALPHA[buf]),
        "n_digits": words.per_row(_DIGIT[buf]),
        "n_stops": words.per_row(_END[buf]),
        "n_ends": by_row(_END[last]),
        "n_stutters": by_row(same),
        "n_lone": by_row(size == 1),
        "n_shouts": by_row((size > 2) & _UPPER[first] & _UPPER[second]),
        "n_bytes": np.diff(words.at),
    }
