"""Best-fit packing of token sequences by bin completion, on the histogram of lengths.

Documents are tokenised once; only pieces' lengths matter for packing, and there are at most
CAPACITY different ones. So the driver packs a histogram (bounded, whatever the corpus): it
completes a bin around the largest piece left. The incumbent is the best-fit-decreasing solution,
that which fills bin by bin, or the best of a few greedy dives. While it is above the lower bound, branch and bound goes
through all undominated fillings of every bin and backtracks at each, dropping a branch as soon
as its waste exceeds what could still beat the incumbent. It ends with a solution that meets the
bound, with the proof that there is none better, or, with a warning, after SEARCH_NODES.

The plan says, for each length, which ranks of pieces go to which bins. A piece's rank among
those of its length is its rank within the task that tokenised it plus the counts of the tasks
before, so no piece is ever gathered or sorted by length.

Nulls and edges: a null or empty text is a piece of the end token alone. Rows that repeat a doc_id,
or have none, are packed each for itself. Texts longer than a sequence are cut, and no other.
Ties: pieces of one length are alike, and go to bins by rank. An empty table gives no sequence.
Other columns, of whatever names, are left out.
"""

from __future__ import annotations

import json
import re
import unicodedata
import warnings
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from archgraph.llm.bpe import Pairs, beside, merge_apart
from archgraph.llm.store import arm, cut, table
from archgraph.llm.text import chunks

CAPACITY, END = 4096, 1
#: A worker's cache of tokenised words starts anew beyond so many.
CACHE = 800_000
#: Of the greedy dives: nodes of the search for one filling, and dives.
FILL_NODES, BRANCHES = 1000, 16
#: Nodes of the branch and bound, those within fillings included; packing is NP-hard, so beyond, the best found so far stands and a warning says so.
SEARCH_NODES = 300_000


class WordBPE:
    """Ids of a `tokenizers` file whose words are lower-cased and end in a suffix, as packed bytes by word."""

    _PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    _PIECE = regex.compile(_PATTERN)
    _WORD = re.compile(r"[^ \t\n\r\v\f]+")
    _ODD = re.compile("[\x1c-\x1f\x85\xa0  -     　]")

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, new = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in merges), strict=True))
        self.pairs = Pairs(left, right, np.arange(len(merges)), new)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        char = dict(zip(shown, map(chr, shown), strict=True)) | {b: chr(256 + i) for i, b in enumerate(hidden)}
        code = {c: b for b, c in char.items()}
        self.near = beside(bytes(code[c] for c in t.removesuffix(suffix)) for t in vocab if all(c in code for c in t.removesuffix(suffix)))
        self.inner = np.array([vocab[char[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[char[b] + suffix] for b in range(256)], np.int32)
        self._split = pre_tokenizers.Split(Regex(self._PATTERN), "removed", invert=True)
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f") or not self._ODD.search(text):
            return text.split()
        return self._WORD.findall(text)

    def cut_up(self, word: str) -> tuple[str, ...]:
        """The pieces of a word that are merged each for itself."""
        plain = word if word.isascii() else unicodedata.normalize("NFC", word)
        plain = plain.lower() if "Σ" not in plain else "".join(c.lower() for c in plain)
        if plain.isalpha():
            return (plain,)
        if plain[-1] in ".," and plain[:-1].isalpha():
            return (plain[:-1], plain[-1])
        if not plain.isascii() and any(unicodedata.category(c) == "Cn" for c in plain):
            # Code points newer than this Python's tables: the library's own tables tell.
            return tuple(plain[a:b] for _, (a, b) in self._split.pre_tokenize_str(plain))
        return tuple(self._PIECE.findall(plain))

    def learn(self, new: list[str]) -> None:
        cut_up = list(map(self.cut_up, new))
        unseen = list(set(chain.from_iterable(cut_up)).difference(self.pieces))
        if len(self.pieces) + len(unseen) > CACHE:
            self.pieces.clear()
            unseen = list(set(chain.from_iterable(cut_up)))
        if unseen:
            coded = [p.encode() for p in unseen]
            sizes = np.fromiter(map(len, coded), np.int64, len(coded))
            raw = np.frombuffer(b"".join(coded), np.uint8)
            symbols = self.inner[raw]
            ends = np.cumsum(sizes) - 1
            symbols[ends] = self.last[raw[ends]]
            ids, kept = merge_apart(raw, symbols, sizes, self.pairs, self.near)
            packed, at = ids.astype("<u4").tobytes(), [0, *(4 * np.cumsum(kept)).tolist()]
            self.pieces.update(zip(unseen, map(packed.__getitem__, map(slice, at, at[1:])), strict=False))
        known = self.pieces
        self.words.update(zip(new, (known[ps[0]] if len(ps) == 1 else b"".join([known[p] for p in ps]) for ps in cut_up), strict=True))

    def encode_all(self, column: pa.Array) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        rows = [self.split(x or "") for x in column.to_pylist()]
        every = set().union(*rows)
        new = every.difference(self.words)
        if new:
            if len(self.words) + len(new) > CACHE:
                self.words.clear()
                new = every
            self.learn(list(new))
        for words in rows:
            yield b"".join(map(self.words.__getitem__, words))


@lru_cache(2)
def word_bpe(path: str) -> WordBPE:
    return WordBPE(path)


def pieces(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32; task and nth: the piece's rank of its length within its task."""
    arm(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = word_bpe(path)
        task = TaskContext.get().partitionId()
        seen = np.zeros(CAPACITY + 1, np.int64)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            for part in chunks(batch):
                row, piece, start, length, crc, nth = [], [], [], [], [], []
                for r, ids in enumerate(model.encode_all(part.column("text"))):
                    ids += end
                    n = len(ids) // 4
                    for k, s in enumerate(range(0, n, CAPACITY)):
                        size = min(CAPACITY, n - s)
                        row.append(r)
                        piece.append(k)
                        start.append(s)
                        length.append(size)
                        crc.append(zlib.crc32(ids[4 * s : 4 * (s + size)]))
                        nth.append(seen[size])
                        seen[size] += 1
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([task] * len(row), pa.int32()), pa.array(nth, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long")


@dataclass(frozen=True)
class Filling:
    """So many equal bins: (length, how often in a bin) from the largest down."""

    bins: int
    items: tuple[tuple[int, int], ...]


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[Filling]:
    """Best-fit decreasing on the histogram: each piece goes to the fullest bin that has room for it.

    Bins of one content are one entry. A bin that takes a piece of a length is then the fullest that
    takes it, so it takes as many as fit before the next bin does.
    """
    rooms: list[int] = []  # ascending, of all bins that are open
    open_: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = {}

    def put(bins: int, room: int, items: tuple[tuple[int, int], ...]) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((bins, items))

    for size in sorted((s for s, n in counts.items() if n), reverse=True):
        n = counts[size]
        while n:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                bins, items = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                room, bins, items = capacity, n, ()
            each = min(room // size, n)
            used = min(bins, n // each)
            put(used, room - each * size, (*items, (size, each)))
            if items and bins > used:
                put(bins - used, room, items)
            n -= used * each
    return [Filling(bins, items) for room in rooms for bins, items in open_[room]]


def largest_first(counts: dict[int, int], capacity: int = CAPACITY) -> list[Filling]:
    """Bin by bin, around the largest piece, always the largest that still fits."""
    left = {k: v for k, v in counts.items() if v}
    order = sorted(left, reverse=True)
    plan = []
    while order:
        room, items = capacity, []
        for size in order:
            k = min(room // size, left[size])
            if k:
                items.append((size, k))
                room -= size * k
            if not room:
                break
        bins = min(left[s] // k for s, k in items)
        for s, k in items:
            left[s] -= bins * k
        order = [s for s in order if left[s]]
        plan.append(Filling(bins, tuple(items)))
    return plan


def fillings(order: list[int], left: dict[int, int], room: int, want: int, waste: int) -> list[tuple[tuple[int, int], ...]]:
    """For a dive, fillings of room by waste then by larger pieces: at most `want`, none wasting over `waste`.

    Depth first over the lengths from the largest, one filling for each total.
    """
    found: list[tuple[int, tuple[tuple[int, int], ...]]] = []
    totals: set[int] = set()
    nodes = 0
    least = order[-1] if order else 0

    def go(i: int, room: int, taken: list[tuple[int, int]]) -> bool:
        nonlocal nodes, waste
        nodes += 1
        if nodes > FILL_NODES:
            return True
        if (room < least or i == len(order)) and room not in totals:
            if room <= waste:
                totals.add(room)
                found.append((room, tuple(taken)))
            if not room:
                return len(found) >= want
        while i < len(order) and order[i] > room:
            i += 1
        closed = i == len(order)
        if closed and room <= waste and room not in totals:
            totals.add(room)
            found.append((room, tuple(taken)))
        for j in range(i, len(order)):
            size = order[j]
            for k in range(min(room // size, left[size]), 0, -1):
                taken.append((size, k))
                stop = go(j + 1, room - size * k, taken)
                taken.pop()
                if stop:
                    return True
        return False

    go(0, room, [])
    found.sort(key=lambda x: x[0])
    return [items for _, items in found[:want]]


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2: for each t, pieces over half don't share bins, and those over capacity - t leave no room for any of t or more."""
    n = np.zeros(capacity + 1, np.int64)
    for size, k in counts.items():
        n[size] += k
    number, words = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(n * np.arange(capacity + 1)))  # of pieces below a length
    t = np.arange(capacity // 2 + 1)
    half = capacity // 2 + 1
    full = number[-1] - number[capacity - t + 1]
    large, filled = number[capacity - t + 1] - number[half], words[capacity - t + 1] - words[half]
    over = words[half] - words[t] - (large * capacity - filled)
    return int((full + large + np.maximum(0, -(-over // capacity))).max())


def dominated(items: list[tuple[int, int]], slack: int, excluded: int) -> bool:
    """Whether an excluded piece can take the place of some pieces that fit into it, and of slack. excluded: a bit for each length."""
    some, many = 0, 0  # sums of at least one and of at least two pieces
    for size, k in items:
        for _ in range(k):
            many |= some << size
            some |= some << size | 1 << size
    if many & excluded:
        return True
    if not slack:
        return False
    sums, reach = (some | 1) << 1, 1
    while reach < slack:
        step = min(reach, slack - reach)
        sums |= sums << step
        reach += step
    return bool(sums & excluded)


class Spent(Exception):
    """The nodes of a search are used up."""


def search(counts: dict[int, int], capacity: int, best: list[Filling], bound: int) -> tuple[list[Filling], bool]:
    """The fewest bins, by bin completion that backtracks at every bin; whether that is proved.

    A filling goes to as many bins as the counts allow, then to one alone, so that every order
    of fillings is reached. States already left with as few bins are not entered again.
    """
    left = {s: n for s, n in counts.items() if n}
    total = sum(s * n for s, n in left.items())
    most, used, nodes = sum(f.bins for f in best), 0, 0
    plan: list[Filling] = []
    seen: dict[tuple, int] = {}

    def tick() -> None:
        nonlocal nodes
        nodes += 1
        if nodes > SEARCH_NODES:
            raise Spent

    def allowed() -> int:
        return (most - 1) * capacity - total - (used * capacity - (total - sum(s * n for s, n in left.items())))

    def options() -> Iterator[Filling]:
        """Undominated fillings around the largest piece; `left` is the same at each step."""
        order = sorted((s for s, n in left.items() if n), reverse=True)
        top, down = order[0], [-s for s in order]
        own = lambda s: left[s] - (s == top)
        rest = np.append(np.cumsum([s * own(s) for s in reversed(order)])[::-1], 0).tolist()
        free = sum(1 << s for s in order if own(s))
        waste = allowed()

        def go(i: int, room: int, taken: list[tuple[int, int]]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
            tick()
            for j in range(bisect_left(down, -room, i), len(order)):
                if room - rest[j] > waste:
                    break
                for k in range(min(room // order[j], own(order[j])), 0, -1):
                    yield from go(j + 1, room - order[j] * k, [*taken, (order[j], k)])
            if room <= waste and not dominated(taken, room, free & ~sum(1 << s for s, k in taken if k == own(s))):
                yield room, taken

        for slack, taken in go(0, capacity - top, []):
            merged = {top: 1}
            for s, k in taken:
                merged[s] = merged.get(s, 0) + k
            bins = min(left[s] // k for s, k in merged.items())
            for n in (bins, 1)[: 1 + (bins > 1)]:
                waste = allowed()
                if n * slack <= waste:
                    yield Filling(n, tuple(sorted(merged.items(), reverse=True)))

    def put(f: Filling, sign: int) -> None:
        nonlocal used
        used += sign * f.bins
        for s, k in f.items:
            left[s] -= sign * k * f.bins

    stack = [options()]
    try:
        while stack:
            f = next(stack[-1], None)
            if f is None:
                stack.pop()
                if plan:
                    put(plan.pop(), -1)
                continue
            put(f, 1)
            plan.append(f)
            key = tuple((s, n) for s, n in left.items() if n)
            if not key and used < most:
                best, most = list(plan), used
                if most <= bound:
                    return best, True
            if key and allowed() >= 0 and seen.get(key, most) > used:
                if len(key) <= 100:
                    seen[key] = used
                stack.append(options())
            else:
                put(plan.pop(), -1)
    except Spent:
        return best, False
    return best, True


def complete(counts: dict[int, int], capacity: int = CAPACITY) -> list[Filling]:
    """Bins for a histogram of lengths: bin completion with branch and bound."""
    total = sum(k * v for k, v in counts.items())
    bound = least_bins(counts, capacity)
    best = min((best_fit(counts, capacity), largest_first(counts, capacity)), key=lambda plan: sum(f.bins for f in plan))
    most = sum(f.bins for f in best)
    branches = 0

    def descend(left: dict[int, int], plan: list[Filling], spent: int, choice: int) -> None:
        """Follows the best fillings down; `choice` is taken for the first bin that offers it."""
        nonlocal best, most, branches
        branches += 1
        while True:
            order = sorted((s for s, n in left.items() if n), reverse=True)
            if not order:
                bins = sum(f.bins for f in plan)
                if bins < most:
                    best, most = list(plan), bins
                return
            top = order[0]
            left[top] -= 1
            allowed = (most - 1) * capacity - total - spent  # waste that can still beat the incumbent
            options = fillings([s for s in order if left[s]], left, capacity - top, choice + 1, max(allowed, 0))
            left[top] += 1
            if allowed < 0:
                return
            if not options:
                rest = sum(k * v for k, v in left.items())
                if rest > capacity:
                    return
                options = [tuple((s, left[s] - (s == top)) for s in order if left[s] - (s == top))]
            items = options[min(choice, len(options) - 1)]
            if len(options) > 1:
                choice = 0
            merged: dict[int, int] = {top: 1}
            for s, k in items:
                merged[s] = merged.get(s, 0) + k
            bins = min(left[s] // k for s, k in merged.items())
            waste = capacity - sum(s * k for s, k in merged.items())
            if waste:
                bins = min(bins, max(1, allowed // waste))
            for s, k in merged.items():
                left[s] -= bins * k
            spent += bins * waste
            plan.append(Filling(bins, tuple(sorted(merged.items(), reverse=True))))

    while most > bound and branches < BRANCHES:
        descend({k: v for k, v in counts.items() if v}, [], 0, branches)
    if most > bound:
        best, proved = search(counts, capacity, best, bound)
        if not proved:
            warnings.warn(f"packing ended after {SEARCH_NODES} nodes with {sum(f.bins for f in best)} sequences; the lower bound is {bound}", stacklevel=2)
    return best


class Plan:
    """For each length, ascending ranks and where pieces from that rank on go."""

    def __init__(self, fillings_: list[Filling], capacity: int = CAPACITY):
        upto = np.zeros(capacity + 1, np.int64)
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        first = 0
        for f in fillings_:
            offset = 0
            for size, k in f.items:
                rows.setdefault(size, []).append((int(upto[size]), k, first, offset))
                upto[size] += f.bins * k
                offset += size * k
            first += f.bins
        self.bins = first
        self.rows = {s: np.array(x, np.int64) for s, x in rows.items()}

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for size in np.unique(length):
            mine = np.flatnonzero(length == size)
            rows = self.rows[int(size)]
            at = rows[np.searchsorted(rows[:, 0], rank[mine], "right") - 1]
            k = rank[mine] - at[:, 0]
            sequence[mine] = at[:, 2] + k // at[:, 1]
            offset[mine] = at[:, 3] + k % at[:, 1] * size
        return sequence, offset


def pack(docs: DataFrame, path: str) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    parts = cut(pieces(docs, path), "pieces")
    per_task = parts.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = {int(r["length"]): int(r["n"]) for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most CAPACITY rows
    plan = Plan(complete(counts))
    before = per_task.selectExpr("length", "task", "coalesce(sum(n) over (partition by length order by task rows between unbounded preceding and 1 preceding), 0) as base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("nth").to_numpy(zero_copy_only=False) + batch.column("base").to_numpy(zero_copy_only=False)
            sequence, offset = plan.place(length, rank)
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return parts.join(before, ["length", "task"]).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
