"""Quality rules: lines that many documents of one host share, and documents that consist of them.

A host is a document's source. A line's identity is its words joined by one space, hashed. For
every host and line, the distinct documents that have the line are counted; exact copies of a
text are one document. A line goes if more than LIMIT documents share it; near copies of a text
count each for itself, and no document's presence keeps a line. A document is depleted, and not
kept, if lines that go have more than DEPLETED percent of its words. Counts are pre-aggregated
before each shuffle; no group is collected.

Nulls and edges: a null or empty text has no line and fails the base rules; all rows with a null
source, or an empty one, are one host; rows with a null doc_id, and rows that repeat one, are
documents of their own, judged each by its own lines. Lines of equal counts (ties) all go or all
stay. Texts are measured whole, however long. An empty table gives no row. Other columns, of
whatever names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archgraph.llm.stats import measure
from archgraph.llm.store import arm, cut, table
from archgraph.llm.text import chunks, list_array, mix, powers, signed

LIMIT, DEPLETED = 10, 50
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32  # of the row, as doc_id may be null or repeated
    for batch in batches:
        for part in chunks(batch):
            words, stats = measure(part.column("text"))
            lines = words.segments()
            row = np.repeat(np.arange(words.rows), np.diff(lines.row_at))
            order = np.lexsort((lines.h, row))
            h, r, n = lines.h[order], row[order], lines.size[order]
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])])) if len(h) else np.zeros(0, np.int64)
            bounds = np.searchsorted(r[new], np.arange(words.rows + 1))
            sizes = np.add.reduceat(n, new) if len(new) else np.zeros(0, np.int64)
            sums = np.zeros(words.n + 1, np.uint64)
            np.cumsum(words.h * powers(words.n), out=sums[1:])
            whole = [signed(mix((words.h[a:b] * powers(b - a)).sum(keepdims=True, dtype=np.uint64)))[0] if b > a else 0 for a, b in zip(words.row_at, words.row_at[1:], strict=False)]
            numbers = np.arange(number, number + words.rows)
            number += words.rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers), part.column("doc_id"), part.column("host"), *(pa.array(stats[k], pa.int64()) for k in BASE), pa.array(whole, pa.int64()), list_array(signed(h[new]), bounds, pa.int64()), list_array(sizes, bounds, pa.int32())],
                names=["row", "doc_id", "host", *BASE, "whole", "h", "size"],
            )


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base figures, base_failed, kept, and n_line_words: words in lines that go."""
    arm(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"))
    got = cut(docs.mapInArrow(_measured, f"row long, doc_id long, host string, {', '.join(f'{k} long' for k in BASE)}, whole long, h array<long>, size array<int>"), "measured")
    lines = got.select("row", "host", "whole", F.explode(F.arrays_zip("h", "size")).alias("l")).select("row", "host", "whole", "l.h", "l.size")
    going = lines.select("h", "host", "whole").distinct().groupBy("h", "host").agg(F.count(F.lit(1)).alias("docs")).where(f"docs > {LIMIT}").select("h", "host")
    lost = lines.join(going, ["h", "host"]).groupBy("row").agg(F.sum("size").alias("n_line_words"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = got.select("row", "doc_id", *BASE).join(lost, "row", "left").withColumn("n_line_words", F.coalesce("n_line_words", F.lit(0).cast("long")))
    return out.select("doc_id", *BASE, failed.alias("base_failed"), (~failed & (100 * F.col("n_line_words") <= DEPLETED * F.col("n_words"))).alias("kept"), "n_line_words")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


_W = r"'[^\x20\x09-\x0D]+'"
OP2_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_W}) AS w FROM documents
), g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), g2 AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) WHERE k > 1
), rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g2) GROUP BY doc_id
), l AS (SELECT doc_id, host, text, raw, regexp_extract_all(raw, {_W}) AS lw FROM (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS raw FROM d)
), solid AS (SELECT doc_id, host, md5(array_to_string(regexp_extract_all(text, {_W}), ' ')) AS whole, raw, array_to_string(lw, ' ') AS norm, len(lw) AS size FROM l WHERE len(lw) > 0
), dup AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n FROM solid GROUP BY doc_id
), going AS (SELECT norm, host FROM solid GROUP BY norm, host HAVING count(DISTINCT whole) > {LIMIT}
), lost AS (SELECT doc_id, sum(size) AS n FROM solid JOIN going USING (norm, host) GROUP BY doc_id
), b AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_line_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id)
), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * n_line_words <= {DEPLETED} * n_words AS kept, n_line_words FROM f
"""
