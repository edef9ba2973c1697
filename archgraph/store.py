"""Intermediate tables in the folder that all executors share.

Loops cut their lineage with `cut`, which writes a DataFrame as Parquet below
`spark.checkpoint.dir` and reads it again: what was written survives lost executors. Where the
session names no folder (tests, one machine), one is made below /tmp.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="archgraph-loops-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


_FOLDERS: set[str] = set()


def _forget(spark: SparkSession, folder: str) -> None:
    """What an application wrote goes with it, unless Spark's process ended first."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except (Py4JError, OSError):
        pass


def cut(df: DataFrame, name: str) -> DataFrame:
    folder = os.path.join(shared_folder(df.sparkSession), "loops", df.sparkSession.sparkContext.applicationId)
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_forget, df.sparkSession, folder)
    path = os.path.join(folder, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arm(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it.

    On a cluster whose nodes don't share that path, send the package with --py-files.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
