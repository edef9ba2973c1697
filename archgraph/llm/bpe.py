"""Byte-level BPE without regular expressions, and the decoding of its ids.

A text's code points are mapped to classes (letter, number, white space, other, and what the
lookahead of the pattern needs to know). An automaton over these classes marks where matches
of the pattern begin. Its transition functions form a small monoid, so the states at all code
points come from an associative scan: functions are composed within blocks, for all blocks at
once, and the blocks' totals are scanned in the same way. The slices between marks are merged
pair by pair; slices seen before come from a bounded cache. A slice is merged in parts where it
holds two bytes that are side by side in no token, as no merge can cross there; texts without
spaces fall into short parts so. The byte offset of every token is kept: decoding copies each
token's bytes to its offset, and ids decode to the text or to any part of it.

Nulls and edges: a null text is encoded as an empty one; empty texts have no ids; texts are encoded
whole, however long. A null doc_id is carried along; rows that repeat a doc_id are texts of their
own, and equal texts have equal ids. Ties: of pairs of equal rank the leftmost is merged. An empty
table gives no row; other columns, of whatever names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from archgraph.llm.store import arm, table
from archgraph.llm.text import chunks

#: A worker's cache of merged slices starts anew beyond so many.
CACHE = 400_000
NONE = np.iinfo(np.int32).max

# Symbols of the automaton. A white space character is LAST (of its run, before other text; a
# space then leads the next match) or RUN; an apostrophe is SHORT or LONG before a contraction.
LETTER, NUMBER, OTHER, SHORT, LONG, LEAD, LAST, RUN = range(8)
FRESH, IN_L, IN_N, IN_O, IN_RUN, IN_LEAD, ONE, TWO = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a match begins at this symbol."""
    if symbol == LETTER:
        if state == ONE:
            return FRESH, False
        if state == TWO:
            return ONE, False
        return IN_L, state not in (IN_L, IN_LEAD)
    if symbol == NUMBER:
        return IN_N, state not in (IN_N, IN_LEAD)
    if symbol in (OTHER, SHORT, LONG):
        if state in (IN_O, IN_LEAD):
            return IN_O, False
        return {OTHER: IN_O, SHORT: ONE, LONG: TWO}[symbol], True
    if symbol == RUN:
        return IN_RUN, state != IN_RUN
    return (IN_LEAD if symbol == LEAD else FRESH), True


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Composition table, value of each function at FRESH, and begins[state, symbol].

    Functions 0-7 are those of the symbols, 8-15 the same at the beginning of a text, 16 the identity.
    """
    functions = [tuple(_step(s, y)[0] for s in range(8)) for y in range(8)] + [(_step(FRESH, y)[0],) * 8 for y in range(8)] + [tuple(range(8))]
    generators = list(dict.fromkeys(functions))
    index = {}
    order = list(functions)
    for i, f in enumerate(functions):
        index.setdefault(f, i)
    todo = list(generators)
    while todo:
        f = todo.pop()
        for g in generators:
            h = tuple(g[x] for x in f)
            if h not in index:
                index[h] = len(order)
                order.append(h)
                todo.append(h)
    table = np.array([[index[tuple(g[x] for x in f)] for g in order] for f in order], np.uint16)
    begins = np.array([[_step(s, y)[1] for y in range(8)] for s in range(8)])
    return table, np.array([f[FRESH] for f in order], np.uint8), begins


_COMPOSE, _AT_FRESH, _BEGINS = _monoid()
_IDENTITY, _BLOCK = 16, 64
_FLAT = _COMPOSE.ravel()
_SIDE = len(_COMPOSE)


def scan(f: np.ndarray) -> np.ndarray:
    """All prefix compositions of a sequence of functions."""
    n = len(f)
    if n <= _BLOCK:
        out = np.empty(n, np.uint16)
        a = _IDENTITY
        for i, x in enumerate(f.tolist()):
            a = int(_COMPOSE[a, x])
            out[i] = a
        return out
    rows = -(-n // _BLOCK)
    padded = np.full(rows * _BLOCK, _IDENTITY, np.uint16)
    padded[:n] = f
    columns = np.ascontiguousarray(padded.reshape(rows, _BLOCK).T)
    for j in range(1, _BLOCK):
        columns[j] = _FLAT[columns[j - 1].astype(np.int32) * _SIDE + columns[j]]
    before = np.empty(rows, np.uint16)
    before[0] = _IDENTITY
    before[1:] = scan(columns[-1])[:-1]
    return _FLAT[before.astype(np.int32) * _SIDE + columns].T.reshape(-1)[:n]


@lru_cache(1)
def _classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER, or RUN for white space, of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for i in range(0x110000):
        c = unicodedata.category(chr(i))[0]
        if c == "L":
            out[i] = LETTER
        elif c == "N":
            out[i] = NUMBER
    # Code points newer than this Python's tables, as far as an installed library knows them.
    newer = "".join(chr(i) for i in range(0x33480) if unicodedata.category(chr(i)) == "Cn")
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER)):
        for c, _ in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(newer):
            out[ord(c)] = kind
    for a, b in ((9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        out[a : b + 1] = RUN
    return out


def matches(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where matches of the pattern begin; at: where the texts begin, and the end."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    y = _classes()[points]
    head = np.zeros(n + 1, bool)
    head[at] = True
    blank = y == RUN
    follows = np.zeros(n, bool)  # other text comes next in the same text
    follows[:-1] = ~blank[1:] & ~head[1:n]
    y[blank & follows] = LAST
    y[blank & follows & (points == 32)] = LEAD
    quote = np.flatnonzero(points == 39)
    if len(quote):
        padded = np.concatenate([points, [0, 0]])
        one, two = padded[quote + 1], padded[quote + 2]
        inside1, inside2 = ~head[np.minimum(quote + 1, n)], ~head[np.minimum(quote + 1, n)] & ~head[np.minimum(quote + 2, n)]
        y[quote[inside1 & np.isin(one, [115, 116, 109, 100])]] = SHORT
        y[quote[inside2 & (((np.isin(one, [114, 118])) & (two == 101)) | ((one == 108) & (two == 108)))]] = LONG
    f = y.astype(np.uint16)
    f[head[:n]] += 8
    after = _AT_FRESH[scan(f)]
    before = np.empty(n, np.uint8)
    before[0] = FRESH
    before[1:] = after[:-1]
    return np.flatnonzero(_BEGINS[before, y] | head[:n])


class Pairs:
    """Mergeable pairs of symbols in an open-addressed table: rank and merged symbol."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, new: np.ndarray):
        keys = left.astype(np.int64) << 20 | right
        self.bits = max(16, int(len(keys)).bit_length() + 3)
        size = 1 << self.bits
        self.key = np.full(size, -1, np.int64)
        self.rank, self.new = np.full(size, NONE, np.int32), np.zeros(size, np.int32)
        mask = size - 1
        for k, slot, r, v in zip(keys.tolist(), self._slot(keys).tolist(), rank.tolist(), new.tolist(), strict=True):
            while self.key[slot] != -1:
                slot = slot + 1 & mask
            self.key[slot], self.rank[slot], self.new[slot] = k, r, v

        self.known: dict[int, tuple[int, int]] = dict(zip(keys.tolist(), zip(rank.tolist(), new.tolist(), strict=True), strict=True))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slot of each pair; of those that can't be merged, an empty one. Symbols under 0 merge with nothing."""
        keys = np.where((left < 0) | (right < 0), np.int64(-2), left.astype(np.int64) << 20 | right)
        slot = self._slot(keys)
        open_ = np.flatnonzero((self.key[slot] != keys) & (self.key[slot] != -1))
        while len(open_):
            slot[open_] = slot[open_] + 1 & (1 << self.bits) - 1
            k = self.key[slot[open_]]
            open_ = open_[(k != keys[open_]) & (k != -1)]
        return slot


def _merge_long(symbols: list[int], pairs: Pairs) -> list[int]:
    """Pair merging with a heap, for slices of any length."""
    n = len(symbols)
    nxt, prv, sym = list(range(1, n + 1)), list(range(-1, n - 1)), list(symbols)
    known = pairs.known.get
    heap = []
    for i in range(n - 1):
        if hit := known(sym[i] << 20 | sym[i + 1]):
            heap.append((hit[0], i, sym[i], sym[i + 1], hit[1]))
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        _, i, a, b, v = pop(heap)
        j = nxt[i]
        if sym[i] != a or j >= n or sym[j] != b:
            continue
        sym[i], sym[j] = v, -1
        k = nxt[i] = nxt[j]
        if k < n:
            prv[k] = i
            if hit := known(v << 20 | sym[k]):
                push(heap, (hit[0], i, v, sym[k], hit[1]))
        k = prv[i]
        if k >= 0 and (hit := known(sym[k] << 20 | v)):
            push(heap, (hit[0], k, sym[k], v, hit[1]))
    return [x for x in sym if x >= 0]


def beside(tokens: Iterable[bytes]) -> np.ndarray:
    """For each two bytes, whether a token has them side by side."""
    out = np.zeros((256, 256), bool)
    for t in tokens:
        for x, y in zip(t, t[1:], strict=False):
            out[x, y] = True
    return out


def merge_apart(raw: np.ndarray, symbols: np.ndarray, sizes: np.ndarray, pairs: Pairs, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`merge` of slices whose bytes are raw, in parts that end between bytes which are beside each other in no token."""
    if not len(raw):
        return merge(symbols, sizes, pairs)
    first = np.zeros(len(raw), bool)
    first[1:] = ~near[raw[:-1], raw[1:]]
    begin = np.cumsum(sizes) - sizes
    first[begin[sizes > 0]] = True
    parts = np.flatnonzero(first)
    ids, kept = merge(symbols, np.diff(np.append(parts, len(raw))), pairs)
    upto = np.append(0, np.cumsum(kept))
    return ids, np.diff(upto[np.searchsorted(parts, np.append(begin, len(raw)))])


def merge(flat: np.ndarray, sizes: np.ndarray, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """Merges sequences of symbols that lie one after the other: always the pair of lowest rank, the leftmost of equals.

    Returns the merged symbols in the same way. Sequences of about one length are merged
    together, a step of each at a time; long ones have a heap each.
    """
    begin = np.cumsum(sizes) - sizes
    kept = np.zeros(len(sizes), np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for low, width in ((0, 4), (4, 8), (8, 16), (16, 32), (32, 64)):
        rows = np.flatnonzero((sizes > low) & (sizes <= width))
        if not len(rows):
            continue
        column = np.arange(width + 1)
        inside = column < sizes[rows][:, None]
        S = np.where(inside, flat[np.minimum(begin[rows][:, None] + column, len(flat) - 1)], -1).astype(np.int32)
        slot = pairs.find(S[:, :-1].ravel(), S[:, 1:].ravel())
        R = pairs.rank[slot].reshape(len(rows), width)
        live = np.arange(len(rows))
        while len(live):
            m = R[live].argmin(axis=1)
            go = R[live, m] != NONE
            live, m = live[go], m[go]
            if not len(live):
                break
            s, r = S[live], R[live]
            k = np.arange(len(live))
            new = pairs.new[pairs.find(s[k, m], s[k, m + 1])]
            source = np.minimum(column + (column > m[:, None]), width)
            s = np.take_along_axis(s, source, 1)
            s[:, -1] = -1
            s[k, m] = new
            r = np.take_along_axis(r, np.minimum(source[:, :-1], width - 1), 1)
            r[:, -1] = NONE
            right = pairs.find(s[k, m], s[k, m + 1])
            r[k, m] = pairs.rank[right]
            inner = np.flatnonzero(m > 0)
            if len(inner):
                r[inner, m[inner] - 1] = pairs.rank[pairs.find(s[inner, m[inner] - 1], s[inner, m[inner]])]
            S[live], R[live] = s, r
        kept[rows] = (S >= 0).sum(axis=1)
        parts.append((rows, S[S >= 0]))
    for i in np.flatnonzero(sizes > 64).tolist():
        done = np.array(_merge_long(flat[begin[i] : begin[i] + sizes[i]].tolist(), pairs), np.int32)
        kept[i] = len(done)
        parts.append((np.array([i]), done))
    at = np.cumsum(kept) - kept
    out = np.empty(int(kept.sum()), np.int32)
    for rows, values in parts:
        n = kept[rows]
        out[np.repeat(at[rows], n) + np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)] = values
    return out, kept


class ByteBPE:
    """Encoder and decoder for a rank file (base64 token and rank a line)."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.token = {v: k for k, v in ranks.items()}
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.shown = [b"%d " % i for i in range(max(self.token) + 1)]
        rows = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, rank = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        self.pairs = Pairs(left, right, rank, rank)
        self.near = beside(ranks)
        #: Of a slice, its ids in decimal, a space behind each, and packed as 32-bit numbers.
        self.cache: dict[bytes, tuple[bytes, bytes]] = {}
        tokens = [self.token.get(i, b"") for i in range(max(self.token) + 1)]
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def learn(self, new: list[bytes]) -> None:
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
        raw = np.frombuffer(b"".join(new), np.uint8)
        ids, sizes = merge_apart(raw, self.byte[raw], np.fromiter(map(len, new), np.int64, len(new)), self.pairs, self.near)
        shown = list(map(self.shown.__getitem__, ids.tolist()))
        packed = ids.astype("<i4").tobytes()
        ends = np.cumsum(sizes).tolist()
        start = 0
        for piece, end in zip(new, ends, strict=True):
            self.cache[piece] = b"".join(shown[start:end]), packed[4 * start : 4 * end]
            start = end

    def encode_both(self, column: pa.Array) -> Iterator[tuple[bytes, np.ndarray]]:
        """The ids of each text, in decimal with a space behind each, and as an array."""
        rows = [x or "" for x in column.to_pylist()]
        whole = "".join(rows)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        raw = whole.encode()
        at = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
        begins = matches(points, at)
        width = 1 + (points > 0x7F) + (points > 0x7FF).astype(np.int64) + (points > 0xFFFF)
        offset = np.concatenate([[0], np.cumsum(width)])
        cuts = offset[np.append(begins, len(points))].tolist()
        pieces = [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        new = set(pieces).difference(self.cache)
        if new:
            if len(self.cache) + len(new) > CACHE:
                new = set(pieces)
            self.learn(list(new))
        found = list(map(self.cache.__getitem__, pieces))
        row_at = np.searchsorted(begins, at).tolist()
        for a, b in zip(row_at, row_at[1:], strict=False):
            yield b"".join([x for x, _ in found[a:b]]), np.frombuffer(b"".join([x for _, x in found[a:b]]), "<i4")

    def encode_all(self, column: pa.Array) -> Iterator[bytes]:
        """The ids of each text in decimal, a space behind each."""
        return (shown for shown, _ in self.encode_both(column))

    def offsets(self, ids: np.ndarray | list[int]) -> np.ndarray:
        """The byte at which each token begins, and the end."""
        return np.append(0, np.cumsum(self.size[np.asarray(ids, np.int64)]))

    def decode(self, ids: bytes | np.ndarray, offsets: np.ndarray | None = None) -> bytes:
        """The text's bytes: each token's are copied to its offset. ids: an array, or in decimal."""
        ids = np.array(ids.split(), np.int64) if isinstance(ids, bytes) else np.asarray(ids, np.int64)
        offsets = self.offsets(ids) if offsets is None else offsets
        return self.bytes[np.repeat(self.at[ids] - offsets[:-1], np.diff(offsets)) + np.arange(offsets[-1])].tobytes()


@lru_cache(2)
def byte_bpe(path: str) -> ByteBPE:
    return ByteBPE(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, and the byte offset in the text at which each token begins, followed by the end."""
    arm(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = byte_bpe(path)
        for batch in batches:
            for part in chunks(batch):
                ids = [x for _, x in model.encode_both(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([model.offsets(x) for x in ids], pa.list_(pa.int64()))], names=["doc_id", "ids", "offsets"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, offsets array<long>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the bytes that the ids stand for, put together by their offsets (of `encode`)."""
    arm(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = byte_bpe(path)
        for batch in batches:
            out = [model.decode(np.array(ids or (), np.int64), np.array(at or (0,), np.int64)) for ids, at in zip(batch.column("ids").to_pylist(), batch.column("offsets").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids", "offsets").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per document: number of ids, and digests of the ids and of what they decode to."""
    arm(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = byte_bpe(path)
        for batch in batches:
            for part in chunks(batch):
                n, a, b = [], [], []
                for shown, ids in model.encode_both(part.column("text")):
                    n.append(len(ids))
                    a.append(hashlib.sha256(shown[:-1]).hexdigest())
                    b.append(hashlib.sha256(model.decode(ids, model.offsets(ids))).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
