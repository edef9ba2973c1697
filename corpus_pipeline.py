"""Corpus pipeline: from raw documents to packed sequences.

STAGES are functions of (spark, docs, sf_dir); each gets what the one before it kept. `run`
applies them to the documents table, writing each result as Parquet in the shared folder. All
stages but the last keep the columns of documents; where a text changes, n_chars follows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archgraph.llm import line_dedup, near_dedup, packing, quality_classifier, substring_dedup
from archgraph.llm.store import cut, drop, scratch, table


def _rewritten(docs: DataFrame, found: DataFrame, removed: int) -> DataFrame:
    """The columns of docs with the cleaned texts; documents that lost their last word go. removed: place of the figure behind them.

    A null or empty text lost nothing and stays.
    """
    names = docs.columns
    rows = found.toDF(*(f"c{i}" for i in range(len(found.columns))))
    text, size = F.col(f"c{names.index('text')}"), names.index("n_chars")
    changed = F.col(f"c{len(names) + removed}") > 0
    kept = rows.where(~changed | text.rlike(r"[^\x20\x09-\x0D]"))
    kept = kept.withColumn(f"c{size}", F.when(changed, F.length(text).cast("long")).otherwise(F.col(f"c{size}")))
    return kept.select(*(f"c{i}" for i in range(len(names)))).toDF(*names)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts.

    A null text is scored as an empty one; rows that repeat a doc_id, or have none, are scored each
    for itself; equal texts are accepted or rejected together, as whole texts of any length; without
    labels all are accepted. An empty table stays empty; columns may have any names.
    """
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows are removed; a document left without a word goes.

    Null texts and rows without a doc_id stay as they are; rows that repeat a doc_id are one document;
    texts may have any length; an empty table stays empty; columns may have any names.
    """
    return _rewritten(docs, line_dedup.dedup_lines(docs), 1)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id.

    Null and empty texts are like nothing and stay, as do rows without a doc_id; of a repeated doc_id
    all rows stay or all go; texts may have any length; an empty table stays empty; columns may have
    any names.
    """
    names = docs.columns
    gone = near_dedup.near_duplicates(docs.select("doc_id", "text")).where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.toDF(*(f"c{i}" for i in range(len(names))))
    return rows.join(gone, F.col(f"c{names.index('doc_id')}").cast("long") == F.col("gone"), "left_anti").toDF(*names)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of lines and passages are removed; a document left without a word goes.

    Null texts and rows without a doc_id stay as they are; rows that repeat a doc_id are one document;
    texts may have any length; an empty table stays empty; columns may have any names.
    """
    return _rewritten(docs, substring_dedup.dedup_substrings(docs), 1)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences.

    A null or empty text is a piece of the end token alone; rows that repeat a doc_id, or have none,
    are packed each for itself; longer documents are cut; an empty table gives no row; other columns,
    of whatever names, are left out.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_classifier", quality), ("line_dedup", lines), ("minhash_near_dedup", near), ("substring_dedup", substrings), ("best_fit_packing", packed)]

#: SQL can neither fit the classifier nor tokenise: tests/llm hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:  # what a stage wrote on its way goes when its result is written
            docs = keep(cut(stage(spark, docs, sf_dir), name))
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
