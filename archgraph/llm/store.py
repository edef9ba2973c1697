"""Tables cut out of a lineage, in the folder that all executors share.

`cut` writes a DataFrame as Parquet below `spark.checkpoint.dir` and reads it again. What was
written survives the loss of executors, is computed once however often it is read, and is
columnar. Where the session names no folder (tests), one is made below /tmp.

Tables don't outlive their use: what is written inside `scratch` goes at its end, but for what is
kept, and the rest goes with the application.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Tables of the `scratch` blocks that are open, the innermost last.
_SCRATCH: list[list[str]] = []
_FOLDERS: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="archgraph-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"file://{_LOCAL[0]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    folder = os.path.join(shared_dir(spark), "archgraph", spark.sparkContext.applicationId)
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_at_end, spark, folder)
    path = os.path.join(folder, f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _PATHS[found] = path
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return found


def delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def drop(df: DataFrame) -> None:
    """Deletes a table that `cut` made and that nothing reads any more."""
    delete(df.sparkSession, _PATHS.pop(df))


def _at_end(spark: SparkSession, folder: str) -> None:
    try:
        delete(spark, folder)
    except (Py4JError, OSError):
        pass  # Spark's process ended first


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are cut inside are deleted at the end, but for those given to the function that it yields."""
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(_PATHS[df])
        return df

    _SCRATCH.append([])
    done = False
    try:
        yield keep
        done = True
    finally:
        for path in _SCRATCH.pop():
            if done and path in kept:
                if _SCRATCH:
                    _SCRATCH[-1].append(path)
            else:
                delete(spark, path)


def arm(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    On a cluster whose nodes don't share that path, send the package with --py-files instead.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    # A batch of rows is held by a Python worker at once: it is bounded in rows and in bytes.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def plain(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """docs with columns c0, c1 ..., which clash with nothing, and the places of doc_id and of text, a string."""
    names = [x.lower() for x in docs.columns]
    doc, text = names.index("doc_id"), names.index("text")
    found = docs.toDF(*(f"c{i}" for i in range(len(names))))
    return found.withColumn(f"c{text}", F.col(f"c{text}").cast("string")), doc, text


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores behind those that are taken."""
    taken, out = {x.lower() for x in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
