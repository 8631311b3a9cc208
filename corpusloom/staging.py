"""Tables that cut lineage.

A staged table is a Parquet folder under the shared directory the cluster names in
``spark.checkpoint.dir``.  It outlives lost executors, freezes results that must not be
computed twice with different outcomes, and gives the planner real sizes.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="corpusloom-")
    return _local_dirs[context.applicationId]


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme Spark would give it, so that Python readers open the same files."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop_path).toString()


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path for readers that run in Python; schemes as in Hadoop paths."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    for paths in _recording.held:
        paths.append(path)
    return path


class _Recording(threading.local):
    """Lists that are being filled; streams cut their micro-batches in threads of their own."""

    def __init__(self):
        self.held: list[list[str]] = []


_recording = _Recording()


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of tables staged inside, so that they can be released once the result is written."""
    paths: list[str] = []
    _recording.held.append(paths)
    try:
        yield paths
    finally:
        _recording.held = [held for held in _recording.held if held is not paths]


def release(spark: SparkSession, paths: list[str], needed: DataFrame | None = None) -> list[str]:
    """Delete staged tables that ``needed`` does not read; returns those it does."""
    # The last part of a path is unique, however its scheme is written.
    read = {part for file in needed.inputFiles() for part in file.split("/")} if needed is not None else set()
    left = [path for path in paths if path.rsplit("/", 1)[-1] in read]
    for path in paths:
        if path not in left:
            hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
    return left


def stage(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back.  With ``path`` an older table there is replaced."""
    spark = df.sparkSession
    target = path or fresh_path(spark, label)
    df.write.mode("overwrite").parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition an input whose files have fewer row groups than there are cores.

    A Parquet row group is one task however many splits its file has.  Nothing is guessed from the
    data: the session setting ``spark.corpusloom.inputPartitions`` asks for it, and without it the input is
    returned as it is.
    """
    parts = df.sparkSession.conf.get("spark.corpusloom.inputPartitions", None)
    return df.repartition(int(parts), *keys) if parts else df
