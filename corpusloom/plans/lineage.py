"""Cutting lineage through tables in the shared folder that the cluster names in ``spark.checkpoint.dir``.

A table written there is computed once (a checkpointed RDD is computed twice unless cached), survives the loss of
executors, and lets Spark drop the shuffle files of everything before it.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_paths: dict[str, SparkSession] = {}
_fallback: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the context's own; a temporary folder only where neither is set and driver and
    executors are one process (``local[n]``: tests, one machine)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not folder and own.isDefined():
        folder = own.get()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _fallback:
            _fallback.append(tempfile.mkdtemp(prefix="corpusloom-"))
            atexit.register(shutil.rmtree, _fallback[0], ignore_errors=True)
        folder = _fallback[0]
    return folder.rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder for a table that is dropped with its scope, at the end of the program at the latest."""
    path = f"{shared_folder(spark)}/corpusloom-{uuid.uuid4().hex}"
    _paths[path] = spark
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read from there."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corpusloom_path = path
    return out


def _delete(path: str) -> None:
    spark = _paths.pop(path, None)
    if spark:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def drop(df: DataFrame) -> None:
    """Deletes the table behind a ``cut`` frame that nothing lazily reads any more."""
    if path := getattr(df, "_corpusloom_path", None):
        _delete(path)


@contextmanager
def scope() -> Iterator[None]:
    """``with scope():`` at its end drops all tables cut inside it. A program that runs on computes, writes or collects
    its results inside: frames made there are lazy and read these tables."""
    before = set(_paths)
    try:
        yield
    finally:
        for path in set(_paths) - before:
            _delete(path)


@atexit.register
def _drop_all() -> None:
    """At the end of the program no result reads these tables any more."""
    for path in list(_paths):
        try:
            _delete(path)
        except Exception:  # noqa: BLE001 - the session may be gone
            return


def release(spark: SparkSession) -> None:
    """Has Spark remove the shuffle files of plans that are done with: it does so when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()
