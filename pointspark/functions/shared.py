"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where all run in one process, as in tests, a temporary folder takes its place."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = tempfile.mkdtemp(prefix="pointspark-")
    return _OWN[context.applicationId]


class _Scopes(threading.local):
    """The tables of the scopes that this thread is in."""

    def __init__(self):
        self.open: list[list[str]] = []


_SCOPES = _Scopes()


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that are saved inside are removed at the end; what was made of them must be written by then.

    Without a scope they stay as long as the shared folder: a result that is not
    read yet needs them.
    """
    _SCOPES.open.append([])
    try:
        yield
    finally:
        for path in _SCOPES.open.pop():
            # Through Hadoop's file access, which knows each path that Spark writes to.
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def save(df: DataFrame, name: str) -> DataFrame:
    """Write and read back: a cut in the lineage that survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/points/{name}-{uuid.uuid4().hex}"
    if _SCOPES.open:
        _SCOPES.open[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def grows(df: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast, since its size grows with the input.

    Spark judges a written table by the bytes of its files; in the driver's
    memory, packed as they are, they are many times as much.
    """
    return df.hint("merge")


def looked_up(df: DataFrame) -> DataFrame:
    """A side of a join with one row for a key, and few beside those of the other side.

    It is hashed by partitions, so the rows that look it up are not sorted, and
    never broadcast.  A key that many rows look up is one row here, so its
    partitions are alike, and Spark splits the other side's.
    """
    return df.hint("shuffle_hash")
