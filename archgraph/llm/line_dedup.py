"""Line dedup: windows of three consecutive lines, found again anywhere in the corpus.

A line is what lies between two newlines; its identity is its words (see text.Words), A-Z in
lower case, joined by one space. Lines without a word are in no window and always stay.
Windows rank by (doc_id, line); all occurrences but the first are later ones, and the lines
that later occurrences cover are removed. Hot windows cost no more than others: counting is
pre-aggregated before the shuffle, and each occurrence meets only its window's first.

Nulls and edges: a null text stays null with zero lines; a null doc_id is left as it is;
documents under three lines have no window. Rows that repeat a doc_id count as one document:
their windows of equal line are one occurrence, and what goes by line goes from each of them.
Ties of (doc_id, line) don't arise otherwise. A text that loses all its words becomes empty.
Texts are cut whole, however long. An empty table gives no row. Columns of docs may have any names.
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
from archgraph.llm.text import Words, chunks, list_array, signed, windows

LINES = 3


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            lines = Words(part.column("text"), lower=True).segments()
            h, bounds = windows(lines.h, lines.row_at, LINES)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), list_array(signed(h), bounds, pa.int64())], names=["doc_id", "w"])


def _without(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Texts without the lines that the windows beginning at the places in the last column cover."""
    for batch in batches:
        out, total, lost = [], [], []
        for t, later in zip(batch.column(text).to_pylist(), batch.columns[-1].to_pylist(), strict=True):
            lines = (t or "").split("\n")
            solid = [i for i, x in enumerate(lines) if x.strip(" \t\n\v\f\r")] if t else []
            drop = {solid[p + k] for p in later or () for k in range(LINES) if p + k < len(solid)}
            total.append(len(solid))
            lost.append(len(drop))
            if not drop:
                out.append(t)
            elif len(drop) == len(solid):
                out.append("")
            else:
                out.append("\n".join(x for i, x in enumerate(lines) if i not in drop))
        columns = [pa.array(out, pa.string()) if i == text else c for i, c in enumerate(batch.columns[:-1])]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(lost, pa.int64())], names=[*batch.schema.names[:-1], "lines", "removed"])


def later_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, later): first lines of the windows that are not the first of their kind."""
    per_doc = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_windows, "doc_id long, w array<long>")
    rows = cut(per_doc.where("size(w) > 0"), "windows").select("doc_id", F.posexplode("w").alias("p", "h"))
    first = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "p")).alias("first")).where("n > 1").select("h", F.col("first.doc_id").alias("d1"), F.col("first.p").alias("p1"))
    later = rows.join(first, "h").where("doc_id <> d1 or p <> p1")
    return later.groupBy("doc_id").agg(F.collect_set("p").alias("later"))  # at most the document's lines


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the same columns, text cleaned, and two more behind them: lines with a word, and how many of them went.

    These are `__lines` and `__removed`, with underscores added where docs has such columns.
    """
    arm(docs.sparkSession)
    rows, doc, text = plain(docs)
    later = later_windows(rows.select(F.col(f"c{doc}").alias("doc_id"), F.col(f"c{text}").alias("text"))).withColumnRenamed("doc_id", "doc")
    joined = rows.join(later, F.col(f"c{doc}").cast("long") == F.col("doc"), "left").drop("doc")
    schema = T.StructType([*rows.schema.fields, T.StructField("lines", T.LongType()), T.StructField("removed", T.LongType())])
    return joined.mapInArrow(partial(_without, text=text), schema).toDF(*docs.columns, *unused(docs.columns, "__lines", "__removed"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).toDF("doc_id", "text", "n_lines", "n_removed")


def lines_sql(source: str) -> str:
    """CTEs up to __out(doc_id, text, n_lines, n_removed) over a relation with doc_id and text."""
    return rf"""
l8_lines AS (
  SELECT doc_id, i, u.line AS raw,
    array_to_string(regexp_extract_all(translate(u.line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS norm
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {source}) u
), l8_solid AS (
  SELECT doc_id, i, norm, row_number() OVER d AS p, lead(norm, 1) OVER d AS n1, lead(norm, 2) OVER d AS n2
  FROM l8_lines WHERE norm <> '' WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), l8_win AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY norm, n1, n2 ORDER BY doc_id, p) AS k FROM l8_solid WHERE n2 IS NOT NULL
), l8_gone AS (
  SELECT DISTINCT s.doc_id, s.i FROM l8_win w JOIN l8_solid s ON s.doc_id = w.doc_id AND s.p BETWEEN w.p AND w.p + 2 WHERE w.k > 1
), l8_out AS (
  SELECT l.doc_id,
    CASE WHEN count(*) FILTER (l.norm <> '') = count(g.i) AND count(g.i) > 0 THEN '' ELSE coalesce(string_agg(l.raw, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') END AS text,
    count(*) FILTER (l.norm <> '') AS n_lines, count(g.i) AS n_removed
  FROM l8_lines l LEFT JOIN l8_gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id
)"""


OP8_SQL = f"WITH {lines_sql('documents')} SELECT doc_id, text, n_lines, n_removed FROM l8_out"
