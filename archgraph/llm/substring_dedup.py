"""Substring dedup: digests of lines and sentences, grouped over the whole corpus.

A unit is a line, cut further behind clauses of at least four words (those that end in one of
. ? ! , ; : alone), so that a passage inside a line is found too. A unit's identity is its words,
A-Z in lower case. Units rank by (doc_id, place); the earliest of equal units stays. A line
that occurs earlier as a whole line is removed whatever its length, so repeated paragraphs are
too. Of other later units, runs of neighbours with 25 words or more are removed, so that short
clauses which two documents have by chance inside their lines do no harm. What is removed
reaches from the end of the word before to the end of the run; its offsets in the original text
are kept as spans. The words of the longest span tell passages from short lines.

Nulls and edges: a null text stays null, a null doc_id is left as it is, texts without words have
no unit. Rows that repeat a doc_id count as one document: their units of equal place are one
occurrence, and what goes by place goes from each of them. Ties of (doc_id, place) don't arise
otherwise. Texts are cut whole, however long. An empty table gives no row. Columns of docs may
have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archgraph.llm.store import arm, cut, plain, table, unused
from archgraph.llm.text import Segments, Words, chunks, list_array, signed

CLAUSE_WORDS, RUN_WORDS = 4, 25
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".?!,;:"]] = True


def units(words: Words) -> Segments:
    if not words.n:
        return words.segments()
    ends = _STOP[words.buf[words.end - 1]]
    wide = words.end - words.start > 1
    ends &= ~(wide & _STOP[words.buf[np.maximum(words.end - 2, 0)]])
    raw = words.segments(ends)
    return words.segments(ends & (np.repeat(raw.size, raw.size) >= CLAUSE_WORDS))


#: What a digest is of: a clause inside a line, a line of one unit, or a line of several. Such a line's digest equals no unit's, as its words would be cut anywhere.
CLAUSE, LINE, LONG_LINE, KINDS = 0, 1, 2, 4


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            words = Words(part.column("text"), lower=True)
            found, lines = units(words), words.segments()
            begin = np.searchsorted(found.first, lines.first)
            long = np.diff(np.append(begin, len(found.first))) > 1
            code = np.arange(len(found.first)) - np.repeat(found.row_at[:-1], np.diff(found.row_at))
            lead = KINDS * code[begin[long]] + LONG_LINE
            code = KINDS * code + CLAUSE
            code[begin[~long]] += LINE
            row = np.repeat(np.arange(words.rows), np.diff(found.row_at))
            order = np.argsort(np.concatenate([row, row[begin[long]]]), kind="stable")
            bounds = np.searchsorted(np.sort(np.concatenate([row, row[begin[long]]])), np.arange(words.rows + 1))
            h, codes = np.concatenate([found.h, lines.h[long]])[order], np.concatenate([code, lead])[order]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), list_array(signed(h), bounds, pa.int64()), list_array(codes, bounds, pa.int32())], names=["doc_id", "h", "code"])


def runs(later: list[int], sizes: np.ndarray) -> list[tuple[int, int]]:
    """Of ascending places: [first, last] of runs of neighbours with at least RUN_WORDS words."""
    out, k = [], 0
    while k < len(later):
        e = k
        while e + 1 < len(later) and later[e + 1] == later[e] + 1:
            e += 1
        if later[e] < len(sizes) and sizes[later[k] : later[e] + 1].sum() >= RUN_WORDS:
            out.append((later[k], later[e]))
        k = e + 1
    return out


def cuts(later: list[int], sizes: np.ndarray, line: np.ndarray) -> list[tuple[int, int]]:
    """[first, last] of what goes, by codes of later units and lines: whole lines, and runs of units."""
    gone = {p for a, b in runs(sorted({x // KINDS for x in later if x % KINDS != LONG_LINE}), sizes) for p in range(a, b + 1)}
    for x in later:
        p = x // KINDS
        if x % KINDS != CLAUSE and p < len(line):
            gone.update(range(p, int(np.searchsorted(line, line[p], "right"))))
    places = sorted(gone)
    first = [p for p in places if p - 1 not in gone]
    last = [p for p in places if p + 1 not in gone]
    return list(zip(first, last, strict=True))


def _without(batches: Iterator[pa.RecordBatch], where: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, batch.schema.names[where]):
            words = Words(part.column(where), lower=True)
            found = units(words)
            old = part.column(where).to_pylist()
            new, lost, longest, spans = list(old), [0] * len(old), [0] * len(old), [""] * len(old)
            for r, later in enumerate(part.columns[-1].to_pylist()):
                if not later or old[r] is None:
                    continue
                u0, w0, b0 = int(found.row_at[r]), int(words.row_at[r]), int(words.at[r])
                own = slice(u0, int(found.row_at[r + 1]))
                going = cuts(later, found.size[own], found.line[own])
                if not going:
                    continue
                raw = old[r].encode()
                point = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
                kept, at, said = [], 0, []
                for a, b in going:
                    first = int(found.first[u0 + a])
                    last = int(found.first[u0 + b] + found.size[u0 + b]) - 1
                    lost[r] += last - first + 1
                    longest[r] = max(longest[r], last - first + 1)
                    begin = int(words.end[first - 1]) - b0 if first > w0 else 0
                    end = int(words.end[last]) - b0
                    kept.append(raw[at:begin])
                    at = end
                    said.append(f"{point[int(words.start[first]) - b0]}-{point[end]}")
                new[r], spans[r] = b"".join([*kept, raw[at:]]).decode(), " ".join(said)
            columns = [pa.array(new, pa.string()) if i == where else c for i, c in enumerate(part.columns[:-1])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(words.row_at), pa.int64()), pa.array(lost, pa.int64()), pa.array(spans, pa.string()), pa.array(longest, pa.int64())], names=[*part.schema.names[:-1], "words", "removed", "spans", "longest"])


def later_units(docs: DataFrame) -> DataFrame:
    """(doc_id, later): codes of the units that occur earlier already, and of the lines that do as whole lines."""
    per_doc = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_digests, "doc_id long, h array<long>, code array<int>")
    rows = cut(per_doc.where("size(h) > 0"), "units").select("doc_id", F.explode(F.arrays_zip("h", "code")).alias("u")).select("doc_id", "u.h", "u.code")
    place, whole = F.struct("doc_id", "code"), F.col("code") % KINDS != CLAUSE
    first = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), F.min(F.when(whole, place)).alias("line")).where("n > 1").drop("n")
    later = rows.join(first, "h").where(place != F.col("first"))
    found = F.when(whole & (place == F.col("line")), F.col("code") - F.col("code") % KINDS).otherwise(F.col("code"))  # an earlier clause makes no whole line
    return later.groupBy("doc_id").agg(F.collect_set(found).alias("later"))  # at most the document's units and lines


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """docs with the same columns, text cleaned, and four more behind them: words, how many of them went, the spans that went, and the words of the longest.

    These are `__words`, `__removed`, `__spans` and `__longest`, with underscores added where docs has such columns.
    """
    arm(docs.sparkSession)
    rows, doc, text = plain(docs)
    later = later_units(rows.select(F.col(f"c{doc}").alias("doc_id"), F.col(f"c{text}").alias("text"))).withColumnRenamed("doc_id", "doc")
    joined = rows.join(later, F.col(f"c{doc}").cast("long") == F.col("doc"), "left").drop("doc")
    schema = T.StructType([*rows.schema.fields, T.StructField("words", T.LongType()), T.StructField("removed", T.LongType()), T.StructField("spans", T.StringType()), T.StructField("longest", T.LongType())])
    return joined.mapInArrow(partial(_without, where=text), schema).toDF(*docs.columns, *unused(docs.columns, "__words", "__removed", "__spans", "__longest"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text")).toDF("doc_id", "text", "n_words", "n_removed", "spans", "longest_removed")


def units_sql(source: str) -> str:
    """CTEs up to l9_out(doc_id, text, n_words, n_removed, spans) over a relation with doc_id and text."""
    return rf"""
l9_tok AS (
  SELECT doc_id, tok, i, sum(len(tok)) OVER (PARTITION BY doc_id ORDER BY i) AS upto, regexp_extract(tok, '[^\x20\x09-\x0D]+$') AS w
  FROM (SELECT doc_id, unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') AS t FROM {source}))
), l9_end AS (
  SELECT *, i = 1 OR contains(tok, chr(10)) AS nl, lag(regexp_matches(w, '(^|[^.?!,;:])[.?!,;:]$'), 1, false) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM l9_tok
), l9_raw AS (
  SELECT *, sum(CASE WHEN nl OR stop THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS raw FROM l9_end
), l9_size AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id, raw) AS size FROM l9_raw
), l9_cut AS (
  SELECT *, nl OR (stop AND lag(size) OVER (PARTITION BY doc_id ORDER BY i) >= {CLAUSE_WORDS}) AS fresh FROM l9_size
), l9_unit AS (
  SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS unit, sum(CASE WHEN nl THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS line FROM l9_cut
), l9_line AS (
  SELECT doc_id, line, string_agg(translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' ORDER BY i) AS norm FROM l9_unit GROUP BY doc_id, line
), l9_again AS (
  SELECT doc_id, line FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, line) AS k FROM l9_line) WHERE k > 1
), l9_units AS (
  SELECT doc_id, unit, min(line) AS line, count(*) AS words, string_agg(translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' ORDER BY i) AS norm,
    min(upto - len(w)) AS a, max(upto) AS b FROM l9_unit GROUP BY doc_id, unit
), l9_later AS (
  SELECT *, unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS island
  FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, unit) AS k FROM l9_units) WHERE k > 1
), l9_long AS (
  SELECT doc_id, min(unit) AS u0, max(unit) AS u1 FROM l9_later GROUP BY doc_id, island HAVING sum(words) >= {RUN_WORDS}
), l9_gone AS (
  SELECT u.* FROM l9_units u JOIN l9_again USING (doc_id, line)
  UNION SELECT u.* FROM l9_units u JOIN l9_long g ON g.doc_id = u.doc_id AND u.unit BETWEEN g.u0 AND g.u1
), l9_runs AS (
  SELECT doc_id, min(unit) AS u0, max(unit) AS u1, min(a) AS a, max(b) AS b, sum(words) AS words
  FROM (SELECT *, unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS island FROM l9_gone) GROUP BY doc_id, island
), l9_spans AS (
  SELECT doc_id, string_agg(CAST(a AS BIGINT) || '-' || CAST(b AS BIGINT), ' ' ORDER BY a) AS spans, CAST(sum(words) AS BIGINT) AS gone, CAST(max(words) AS BIGINT) AS longest FROM l9_runs GROUP BY doc_id
), l9_kept AS (
  SELECT t.doc_id, count(*) AS n_words, coalesce(string_agg(t.tok, '' ORDER BY t.i) FILTER (r.doc_id IS NULL), '') AS body
  FROM l9_unit t LEFT JOIN l9_runs r ON r.doc_id = t.doc_id AND t.unit BETWEEN r.u0 AND r.u1 GROUP BY t.doc_id
), l9_out AS (
  SELECT d.doc_id, CASE WHEN k.doc_id IS NULL THEN d.text ELSE k.body || regexp_extract(d.text, '[\x20\x09-\x0D]*$') END AS text,
    coalesce(k.n_words, 0) AS n_words, coalesce(s.gone, 0) AS n_removed, coalesce(s.spans, '') AS spans, coalesce(s.longest, 0) AS longest_removed
  FROM {source} d LEFT JOIN l9_kept k USING (doc_id) LEFT JOIN l9_spans s USING (doc_id)
)"""


OP9_SQL = f"WITH {units_sql('documents')} SELECT doc_id, text, n_words, n_removed, spans, longest_removed FROM l9_out"
