"""Watching source trees and streams of edges with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from archgraph.model import Graph
from archgraph.operators.history import diff_nodes
from archgraph.sources import code, stored
from archgraph.sources.code import scan, supported

_FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, root: str, store: str, checkpoint: str, on_change: Callable[[DataFrame, int], None] | None = None, every: str = "1 second") -> StreamingQuery:
    """Rescans files as they come or change, merges them into the graph stored at `store`, and reports the difference.

    The trigger's interval gathers what changes within it. Files that went meanwhile are taken out
    with the next batch, as the file source tells of none. State is the stored graph alone: batch n
    is written to `store/n` and starts from the last one complete before it, so that a batch that is
    run again reads what it read before. Batches without a source file write nothing and lose nothing;
    of the others the last two are kept. `latest` names the newest.
    """
    base = root.rstrip("/").removeprefix("file://")
    stream = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), f"^{base.replace('.', '[.]')}/", "")
    files = stream.select(path.alias("path"), "content").where(supported(F.col("path")))

    def batch(changed: DataFrame, n: int) -> None:
        if changed.isEmpty():
            return
        there = code.files(spark, root)
        # The file source leaves out names with a leading underscore: these are read again.
        changed = changed.union(there.where(F.col("path").rlike("(^|/)_[^/]*$")))
        done = [k for k in versions(spark, store) if k < n]
        before = stored.read_parquet(spark, f"{store}/{done[-1]}") if done else None
        gone = None if before is None else before.nodes.where("file is not null and provenance = 'scan'").select(F.col("file").alias("path")).distinct().join(there.select("path"), "path", "left_anti")
        after, _ = scan(changed, into=before, gone=gone)
        stored.write_parquet(after, f"{store}/{n}")
        if on_change:
            old = before or Graph(after.nodes.limit(0), after.edges.limit(0))
            on_change(diff_nodes(old, stored.read_parquet(spark, f"{store}/{n}")), n)
        for k in done[:-1]:
            remove(spark, f"{store}/{k}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def _path(spark: SparkSession, path: str):
    jvm = spark._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, store: str) -> list[int]:
    """The batches whose graph is written to the end, in order: edges are written last."""
    path, fs = _path(spark, store)
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(x) for x in names if x.isdigit() and fs.exists(_path(spark, f"{store}/{x}/edges/_SUCCESS")[0]))


def remove(spark: SparkSession, path: str) -> None:
    found, fs = _path(spark, path)
    fs.delete(found, True)


def latest(spark: SparkSession, store: str) -> Graph | None:
    """The newest graph of a watched tree."""
    done = versions(spark, store)
    return stored.read_parquet(spark, f"{store}/{done[-1]}") if done else None


def churn_by_window(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, file, hunks) of a stream of hunks(ts, file) in event time; what is later than `late` is left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "file").agg(F.count(F.lit(1)).alias("hunks")).select(F.col("w.start").alias("start"), "file", "hunks")
