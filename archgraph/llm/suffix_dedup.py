"""Sparse suffix arrays: passages of 50 words or more that occur again.

Only suffixes at content-selected positions are retained: of every window of 50 words, the
position whose 16-gram hashes lowest (the leftmost of equals). Equal windows select equal
positions, so a repeated passage meets its copy at such a suffix. A retained suffix stands
for the windows that select it (`lo` to `lo + n - 1`), and knows the text that these cover,
its context: `left` words before the position and those from it on.

1. Suffixes of one 16-gram and equal contexts match as far as they reach on both sides, so they
   collapse into one with a count before anything is shuffled, however many copies there are.
2. Of 16-grams with several contexts, the suffixes are sorted by (16-gram, following words,
   preceding words) in ranges over the cluster: a suffix array in pieces.
3. Neighbours are compared: the words that they have in common from the position on bound the
   runs of suffixes that agree on so many words to the right. A window takes as many words to
   the right as its 50 leave it; within its run, suffixes match it if they extend as far to
   the left with equal words. So not just immediate neighbours are found: a third suffix that
   sorts in between may agree less to the left.
4. Suffixes of one 16-gram that lie in more than one range, or are more than BLOCK, are not
   held by one task: their windows, hashed on both sides of the position, are grouped instead.

The union of a document's matched windows is what repeats, exactly as far as it does.

Result: one row per row of docs, with word offsets. `repeated_*`: all occurrences;
`removed_*`: those after the first, by (doc_id, offset), of their 50 words.

Nulls and edges: a null, empty or short text has no window; rows with a null doc_id get zeros; rows
that repeat a doc_id count as one document, whose passages are those of all its rows, and get the
same spans. Ties of (doc_id, offset) don't arise otherwise. Texts are read whole, however long. An
empty table gives no row; other columns, of whatever names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archgraph.llm.store import arm, cut, scratch, table
from archgraph.llm.text import U64, Words, chunks, flat, inverse_powers, list_array, mix, powers, signed

WORDS, GRAM = 50, 16
#: Suffixes of one 16-gram that a task holds at once.
BLOCK = 20_000


def _select(grams: np.ndarray, count: int) -> np.ndarray:
    """For each of count windows, the place of the least of its WORDS - GRAM + 1 grams, leftmost first."""
    w = WORDS - GRAM + 1
    value, place = grams.copy(), np.arange(len(grams))
    reach = 1  # value[i], place[i]: least of grams[i : i + reach]
    while reach * 2 <= w:
        left, right = value[:-reach], value[reach:]
        take = right < left
        value, place = np.where(take, right, left), np.where(take, place[reach:], place[:-reach])
        reach *= 2
    rest = w - reach
    left, right = value[:count], value[rest : rest + count]
    return np.where(right < left, place[rest : rest + count], place[:count])


def contexts(words: Words, begin: np.ndarray, n: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Hashes of the words that n windows from `begin` on cover, and of their gram."""
    sums = np.zeros(words.n + 1, np.uint64)
    np.cumsum(words.h * powers(words.n), out=sums[1:])
    inside = (sums[begin + n + WORDS - 1] - sums[begin]) * inverse_powers(words.n + 1)[begin]
    return mix(mix(inside + n.astype(np.uint64)) + gram)


class Suffixes:
    """The retained suffixes of a chunk: row, place p, gram h, first window lo, windows n, words `left` of p, context hash."""

    def __init__(self, words: Words):
        self.words = words
        grams, gb = words.windows(GRAM)
        self.window, self.wb = words.windows(WORDS)
        rows, p, lo, n, h = [], [], [], [], []
        for r in range(words.rows):
            count = int(self.wb[r + 1] - self.wb[r])
            if not count:
                continue
            g = grams[gb[r] : gb[r + 1]]
            at = _select(g, count)
            begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            rows.append(np.full(len(begin), r))
            p.append(at[begin])
            lo.append(begin)
            n.append(np.diff(np.append(begin, count)))
            h.append(g[at[begin]])
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        self.row, self.p, self.lo, self.n, self.h = join(rows, np.int64), join(p, np.int64), join(lo, np.int64), join(n, np.int64), join(h, np.uint64)
        self.left = self.p - self.lo
        self.context = contexts(words, words.row_at[self.row] + self.lo, self.n, self.h)
        self.row_at = np.searchsorted(self.row, np.arange(words.rows + 1))


def _retain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            words = Words(part.column("text"))
            s = Suffixes(words)
            lists = [list_array(x, s.row_at, k) for x, k in ((signed(s.h), pa.int64()), (signed(s.context), pa.int64()), (s.lo, pa.int32()), (s.n, pa.int32()), (s.left, pa.int32()))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(words.row_at), pa.int64()), *lists], names=["doc_id", "n_words", "gram", "context", "lo", "n", "left"])


PASSAGE = ["gram", "context", "doc_id", "lo", "n", "left", "suffix", "before"]


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted contexts' words, as hashes that sort like bytes: those behind the 16-gram, and those before it, the nearest first."""
    for batch in batches:
        for part in chunks(batch):
            words = Words(part.column("text"))
            h = words.h.astype(">u8")
            rows, wanted = [], []
            for r, own in enumerate(part.column("wanted").to_pylist()):
                fits = [x for x in own if x["lo"] + x["n"] + WORDS - 1 <= words.row_at[r + 1] - words.row_at[r]]
                wanted.extend(fits)
                rows.extend([r] * len(fits))
            gram, context, lo, n, left = (np.array([x[k] for x in wanted], np.int64) for k in ("gram", "context", "lo", "n", "left"))
            begin = words.row_at[np.array(rows, np.int64)] + lo
            # Of rows that repeat a doc_id, those that have the context there.
            mine = np.flatnonzero(signed(contexts(words, begin, n, gram.view(np.uint64))) == context) if len(wanted) else np.zeros(0, np.int64)
            at, rest, end = begin + left, begin + left + GRAM, begin + n + WORDS - 1
            columns = [
                pa.array(gram[mine]), pa.array(context[mine]), part.column("doc_id").take(pa.array(np.array(rows, np.int64)[mine])), pa.array(lo[mine], pa.int32()), pa.array(n[mine], pa.int32()), pa.array(left[mine], pa.int32()),
                pa.array([h[rest[i] : end[i]].tobytes() for i in mine], pa.binary()), pa.array([h[begin[i] : at[i]][::-1].tobytes() for i in mine], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=PASSAGE)


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of word hashes, padded with zeros to width, and their lengths."""
    raw, at = flat(column)
    size = np.diff(at) // 8
    out = np.zeros((len(size), width), np.uint64)
    inside = np.arange(width) < size[:, None]
    out[inside] = raw.view(">u8").astype(np.uint64)
    return out, size


class Sorted:
    """Suffixes in sorted order: which windows of theirs match, and hashes of all."""

    def __init__(self, rows: pa.Table):
        number = lambda name: rows.column(name).to_numpy()
        join = lambda name: rows.column(name).combine_chunks() if rows.num_rows else pa.array([], pa.binary())
        gram, left, n = number("gram"), number("left").astype(np.int64), number("n").astype(np.int64)
        right, size = _matrix(join("suffix"), WORDS)  # behind the 16-gram
        before, _ = _matrix(join("before"), WORDS)
        m = rows.num_rows
        common = np.zeros(m, np.int64)  # words in common with the row before, from the position on
        if m > 1:
            same = (right[1:] == right[:-1]) & (np.arange(WORDS) < np.minimum(size[1:], size[:-1])[:, None])
            common[1:] = np.where(gram[1:] == gram[:-1], GRAM + np.logical_and.accumulate(same, axis=1).sum(axis=1), 0)
        depth = np.arange(WORDS + 1)
        starts = np.where(common[:, None] < depth, np.arange(m)[:, None], 0)
        run = np.maximum.accumulate(starts, axis=0)  # [i, d]: first row of those that agree with row i on d words
        leftward = np.zeros((m, WORDS + 1), np.uint64)  # [i, k]: hash of the k words before
        np.cumsum(before * powers(WORDS), axis=1, out=leftward[:, 1:])
        rightward = np.zeros((m, WORDS + 1), np.uint64)
        np.cumsum(right * powers(WORDS), axis=1, out=rightward[:, 1:])

        self.row = np.repeat(np.arange(m), n)
        self.t = np.arange(len(self.row)) - np.repeat(np.cumsum(n) - n, n)
        reach = left[self.row] - self.t  # words that the window has before the position
        self.before = mix(leftward[self.row, reach] + U64(1) + reach.astype(np.uint64))
        self.run = run[self.row, WORDS - reach] * (WORDS + 1) + reach
        self.hash = mix(self.before + mix(rightward[self.row, WORDS - reach - GRAM] + gram[self.row].view(np.uint64)))
        self.place = number("doc_id")[self.row], number("lo")[self.row] + self.t
        self.bounds = np.concatenate([[0], np.cumsum(n)])

    def masks(self) -> tuple[np.ndarray, np.ndarray]:
        """Per suffix, bits of the windows that another one has too, and of those that are the first such."""
        order = np.lexsort((self.place[1], self.place[0], self.before, self.run))
        new = np.ones(len(order), bool)
        run, before = self.run[order], self.before[order]
        new[1:] = (run[1:] != run[:-1]) | (before[1:] != before[:-1])
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, len(order)))
        doc, at = (x[order] for x in self.place)
        lead = (doc == np.repeat(doc[begin], count)) & (at == np.repeat(at[begin], count))
        several = np.repeat(~lead[np.append(begin[1:], len(order)) - 1], count) if len(order) else lead  # one place, of rows that repeat a doc_id, is one
        shared, first = np.zeros(len(order), bool), np.zeros(len(order), bool)
        shared[order], first[order] = several, several & lead
        out = []
        for mask in (shared, first):
            bits = np.where(mask, np.left_shift(np.int64(1), self.t), 0)
            sums = np.concatenate([[0], np.cumsum(bits)])
            out.append(sums[self.bounds[1:]] - sums[self.bounds[:-1]])
        return out[0], out[1]


MATCH = "context long, doc_id long, lo int, shared long, leads long, w array<long>"


def _neighbours(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Of sorted suffixes: masks of matched windows, or all windows (w) where a 16-gram's suffixes may not all be here."""
    names = [x.split()[0] for x in MATCH.split(", ")]

    def done(rows: pa.Table) -> pa.RecordBatch:
        shared, leads = Sorted(rows).masks()
        none = pa.nulls(rows.num_rows, pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([*(rows.column(x).combine_chunks() for x in ("context", "doc_id", "lo")), pa.array(shared), pa.array(leads), none], names=names)

    def left_open(rows: pa.Table) -> pa.RecordBatch:
        s, none = Sorted(rows), pa.nulls(rows.num_rows, pa.int64())
        return pa.RecordBatch.from_arrays([*(rows.column(x).combine_chunks() for x in ("context", "doc_id", "lo")), none, none, list_array(signed(s.hash), s.bounds, pa.int64())], names=names)

    rest: pa.Table | None = None
    open_gram: int | None = None  # its suffixes aren't all here
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        gram = rows.column("gram").to_numpy()
        if open_gram is None:
            open_gram = int(gram[0])
        last = int(np.searchsorted(gram, gram[-1]))
        some = int(np.searchsorted(gram, open_gram, "right")) if gram[0] == open_gram else 0
        if some == len(gram) or len(gram) - last > block:
            open_gram, last = int(gram[-1]), len(gram)
            tail = max(some, int(np.searchsorted(gram, gram[-1])))
            yield from (left_open(x) for x in (rows.slice(0, some), rows.slice(tail)) if x.num_rows)
            if tail > some:
                yield done(rows.slice(some, tail - some))
            rest = None
            continue
        if some:
            yield left_open(rows.slice(0, some))
        if last > some:
            yield done(rows.slice(some, last - some))
        rest = rows.slice(last)
    if rest is not None and rest.num_rows:
        yield left_open(rest)


def _spans(hits: list[tuple[int, int]]) -> tuple[int, str]:
    """Of (first window, mask): how many words are covered, and the merged word ranges."""
    begins = sorted(lo + i for lo, mask in hits for i in range(mask.bit_length()) if mask >> i & 1)
    total, said, a, b = 0, [], -1, -1
    for x in begins:
        if x > b:
            if b > a:
                said.append(f"{a}-{b}")
                total += b - a
            a = x
        b = x + WORDS
    if b > a:
        said.append(f"{a}-{b}")
        total += b - a
    return total, " ".join(said)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [[], [], [], []]
        for hits in batch.column("hits").to_pylist():
            for k, name in enumerate(("again", "later")):
                n, s = _spans([(x["lo"], x[name]) for x in hits or ()])
                out[2 * k].append(n)
                out[2 * k + 1].append(s)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_words"), *(pa.array(x, pa.string() if i % 2 else pa.int64()) for i, x in enumerate(out))],
            names=["doc_id", "n_words", "repeated_words", "repeated_spans", "removed_words", "removed_spans"],
        )


def _matched(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """What `_neighbours` finds among the wanted contexts, sorted over the cluster."""
    passages = cut(docs.join(wanted, "doc_id").mapInArrow(_passages, "gram long, context long, doc_id long, lo int, n int, left int, suffix binary, before binary"), "passages")
    array = passages.repartitionByRange("gram", F.expr("substring(suffix, 1, 16)")).sortWithinPartitions("gram", "suffix", "before", "context")
    return array.mapInArrow(partial(_neighbours, block=BLOCK), MATCH)


def repeated_passages(docs: DataFrame) -> DataFrame:
    arm(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    kept = cut(docs.mapInArrow(_retain, "doc_id long, n_words long, gram array<long>, context array<long>, lo array<int>, n array<int>, left array<int>"), "suffixes")
    suffixes = kept.where("doc_id is not null").select("doc_id", F.explode(F.arrays_zip("gram", "context", "lo", "n", "left")).alias("s")).select("doc_id", "s.*")
    kinds = suffixes.groupBy("gram", "context", "n", "left").agg(F.min(F.struct("doc_id", "lo")).alias("first"), F.max(F.struct("doc_id", "lo")).alias("last"))
    kinds = kinds.select("gram", "context", "n", "left", "first", (F.col("first") != F.col("last")).alias("copied"))
    grams = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.max("copied").alias("some")).where("kinds > 1 or some").drop("some")
    common = cut(kinds.join(grams, "gram"), "contexts")

    several = common.where("kinds > 1").select("first.doc_id", F.struct("gram", "context", "first.lo", "n", "left").alias("c"))
    wanted = several.groupBy("doc_id").agg(F.collect_list("c").alias("wanted"))  # at most the document's suffixes
    with scratch(docs.sparkSession) as keep:
        matched = keep(cut(_matched(docs, wanted), "matched"))

    each = matched.where("w is not null").select("context", "doc_id", "lo", F.posexplode("w").alias("i", "w")).select("context", "w", "i", F.struct("doc_id", (F.col("lo") + F.col("i")).alias("at")).alias("place"))
    same = each.groupBy("w").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first <> last").drop("last")
    bit = F.expr("shiftleft(1L, i)")
    grouped = each.join(same, "w").groupBy("context").agg(F.bit_or(bit).alias("shared"), F.coalesce(F.bit_or(F.when(F.col("place") == F.col("first"), bit)), F.lit(0).cast("long")).alias("leads"))
    shared = matched.where("w is null and shared <> 0").select("context", "shared", "leads").unionByName(grouped)
    every = F.expr("shiftleft(1L, n) - 1")
    none = F.lit(0).cast("long")
    masks = common.join(shared, "context", "left").select(
        "context", "first",
        F.when(F.col("copied"), every).otherwise(F.coalesce("shared", none)).alias("again"),
        every.bitwiseAND(F.bitwise_not(F.coalesce(F.col("shared"), none))).bitwiseOR(F.coalesce("leads", none)).alias("own"),
    ).where("again <> 0")
    mine = suffixes.select("doc_id", "context", "lo").join(masks, "context").select(
        "doc_id", "lo", "again",
        F.when((F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.lo") == F.col("lo")), F.col("again").bitwiseAND(F.bitwise_not("own"))).otherwise(F.col("again")).alias("later"),
    )
    hits = mine.groupBy(F.col("doc_id")).agg(F.collect_set(F.struct("lo", "again", "later")).alias("hits"))  # at most the document's suffixes
    return kept.select("doc_id", "n_words").join(hits, "doc_id", "left").mapInArrow(_merge, "doc_id long, n_words long, repeated_words long, repeated_spans string, removed_words long, removed_spans string")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def _spans_sql(which: str, name: str) -> str:
    return f"""
{name}_i AS (
  SELECT doc_id, s, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + {WORDS} OR lag(s) OVER (PARTITION BY doc_id ORDER BY s) IS NULL THEN 1 ELSE 0 END AS fresh FROM {which}
), {name}_g AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM {name}_i
), {name}_m AS (SELECT doc_id, min(s) AS a, max(s) + {WORDS} AS b FROM {name}_g GROUP BY doc_id, g
), {name} AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS words, string_agg(CAST(a AS BIGINT) || '-' || CAST(b AS BIGINT), ' ' ORDER BY a) AS spans FROM {name}_m GROUP BY doc_id
)"""


OP7_SQL = rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i AS s, array_to_string(w[i + 1:i + {WORDS}], ' ') AS x FROM (SELECT doc_id, w, unnest(range(0, len(w) - {WORDS - 1})) AS i FROM t WHERE len(w) >= {WORDS})
), r AS (
  SELECT doc_id, s, count(*) OVER (PARTITION BY md5(x)) AS k, row_number() OVER (PARTITION BY md5(x) ORDER BY doc_id, s) AS nth FROM win
), again AS (SELECT doc_id, s FROM r WHERE k > 1), later AS (SELECT doc_id, s FROM r WHERE nth > 1
),{_spans_sql("again", "rep")},{_spans_sql("later", "rem")}
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(rep.words, 0) AS repeated_words, coalesce(rep.spans, '') AS repeated_spans,
  coalesce(rem.words, 0) AS removed_words, coalesce(rem.spans, '') AS removed_spans
FROM t LEFT JOIN rep USING (doc_id) LEFT JOIN rem USING (doc_id)
"""
