"""Vectorised text kernels over Arrow string columns.

A chunk of texts is seen as one flat byte array, so that finding words, hashing them and
forming word windows cost a few array passes a chunk and no Python work a word. Hashes are
64 bits wide and are used only as identities inside this package; they never leave a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in chunks of about so many bytes; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 21
#: Python workers get rows in batches of so many, which bounds what a worker holds at once.
U64 = np.uint64

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_P = U64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POW = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums of products of hashes stay well spread."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd constant modulo 2**64."""
    global _POW
    if len(_POW) < n:
        grown = np.full(max(n, 1024), _P, np.uint64)
        grown[0] = 1
        _POW = np.cumprod(grown, dtype=np.uint64)
    return _POW[:n]


_INVERSE = U64(pow(int(_P), -1, 1 << 64))
_IPOW = np.ones(1, np.uint64)


def inverse_powers(n: int) -> np.ndarray:
    global _IPOW
    if len(_IPOW) < n:
        grown = np.full(max(n, 1024), _INVERSE, np.uint64)
        grown[0] = 1
        _IPOW = np.cumprod(grown, dtype=np.uint64)
    return _IPOW[:n]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the byte offsets of its rows; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about `limit` bytes of text each."""
    n = batch.num_rows
    if not n:
        return
    _, at = flat(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


class Words:
    """The words of a chunk of texts: maximal runs of bytes other than 0x20 and 0x09-0x0D.

    start, end: byte range in buf; row_at[r]:row_at[r + 1] are the words of row r; h: hashes.
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        buf, self.at = flat(column)
        if lower:
            buf = _LOWER[buf]
        self.buf, self.rows = buf, len(column)
        solid = ~_SPACE[buf]
        edge = np.zeros(len(buf) + 1, np.int8)
        edge[: len(buf)] = solid
        first = np.zeros(len(buf), bool)
        if len(buf):
            first[0] = solid[0]
            first[1:] = solid[1:] & ~solid[:-1]
            begins = self.at[:-1][self.at[:-1] < len(buf)]
            first[begins] = solid[begins]  # a word never goes on into the next row
        self.start = np.flatnonzero(first)
        last = np.zeros(len(buf), bool)
        if len(buf):
            last[:-1] = solid[:-1] & (~solid[1:] | first[1:])
            last[-1] = solid[-1]
        self.end = np.flatnonzero(last) + 1
        self.solid = solid
        self.row_at = np.searchsorted(self.start, self.at)
        self.n = len(self.start)
        self._h: np.ndarray | None = None

    @property
    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(self.rows), np.diff(self.row_at))

    @property
    def h(self) -> np.ndarray:
        if self._h is None:
            if not self.n:
                self._h = np.zeros(0, np.uint64)
            else:
                size = self.end - self.start
                inner = np.cumsum(size) - size
                codes = self.buf[self.solid]
                place = np.arange(len(codes)) - np.repeat(inner, size)
                values = _BYTE[codes] * powers(int(size.max()))[place]
                self._h = mix(np.add.reduceat(values, inner) + size.astype(np.uint64) * U64(0xD6E8FEB86659FD93))
        return self._h

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of k words inside a row, and their row boundaries."""
        return windows(self.h, self.row_at, k)

    def segments(self, after: np.ndarray | None = None) -> Segments:
        """The words in runs: a run ends with its line, its row, and after each word that `after` marks."""
        return Segments(self, after)

    def per_row(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each row a mask over the bytes marks."""
        sums = np.zeros(len(self.buf) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[self.at[1:]] - sums[self.at[:-1]]


def windows(h: np.ndarray, row_at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k consecutive items of a row, and their row boundaries."""
    count = np.maximum(np.diff(row_at) - (k - 1), 0)
    bounds = np.concatenate([[0], np.cumsum(count)])
    if not bounds[-1]:
        return np.zeros(0, np.uint64), bounds
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(len(h)), out=sums[1:])
    begin = np.arange(bounds[-1]) - np.repeat(bounds[:-1], count) + np.repeat(row_at[:-1], count)
    return mix((sums[begin + k] - sums[begin]) * inverse_powers(len(h))[begin] + U64(k)), bounds


class Segments:
    """Runs of words: first word of each, number of words, hash of the words, and rows."""

    def __init__(self, words: Words, after: np.ndarray | None):
        n = words.n
        lines = np.cumsum(words.buf == 10)
        fresh = np.zeros(n, bool)
        if n:
            line = lines[words.start]
            fresh[1:] = line[1:] != line[:-1]
            fresh[words.row_at[:-1][words.row_at[:-1] < n]] = True
            if after is not None:
                fresh[1:] |= after[:-1]
        self.first = np.flatnonzero(fresh)
        self.size = np.diff(np.append(self.first, n))
        self.row_at = np.searchsorted(self.first, words.row_at)
        self.line = line[self.first] if n else np.zeros(0, np.int64)
        if n:
            place = np.arange(n) - np.repeat(self.first, self.size)
            self.h = mix(np.add.reduceat(words.h * powers(int(self.size.max()))[place], self.first) + self.size.astype(np.uint64) * U64(0xA24BAED4963EE407))
        else:
            self.h = np.zeros(0, np.uint64)


def shingle_sets(words: Words, k: int = 3) -> list[np.ndarray]:
    """Each row's distinct k-word shingles as sorted hashes; with fewer words, the whole sequence is one."""
    grams, bounds = words.windows(k)
    out = []
    for r in range(words.rows):
        a, b = int(words.row_at[r]), int(words.row_at[r + 1])
        if b - a >= k:
            s = np.sort(grams[bounds[r] : bounds[r + 1]])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            out.append(mix((words.h[a:b] * powers(k)[: b - a]).sum(keepdims=True, dtype=np.uint64) + U64(1000 + b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def list_array(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32), pa.int32()), pa.array(values, kind))


def texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]
