"""Tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch while a shared table is written: rows may be whole texts, and both the JVM and Python hold a
#: batch outside of any limit.
BATCH_ROWS = 500
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_local: dict[str, str] = {}
_open = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where the session names none, a temporary one on a
    local master (tests), and an error on any other, whose executors would each write to a disk of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="weftable-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return "file://" + _local[app]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; removed with the enclosing scratch()."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if scopes := getattr(_open, "scopes", None):
        scopes[-1].append(path)
    return path


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Arrow batches of at most `rows` rows for the jobs run inside; the session's own setting is put back after."""
    before = spark.conf.get(_BATCH, None)
    now = int(before if before is not None else spark.conf.get(_BATCH))
    if 0 < now <= rows:
        yield
        return
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH)
        else:
            spark.conf.set(_BATCH, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives lost executors, is computed once."""
    path = shared_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    jvm = spark._jvm.org.apache.hadoop.fs
    for p in paths:
        path = jvm.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """What scratch() gives: result() writes a table that outlives it."""

    def __init__(self, outer: list[list[str]]) -> None:
        self._scopes = outer

    def result(self, df: DataFrame, name: str) -> DataFrame:
        mine = self._scopes.pop()
        try:
            return written(df, name)
        finally:
            self._scopes.append(mine)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Shared tables made inside are removed at the end, after success and after an error alike.

    What is returned from inside must not read them any more: it is a result() or a value."""
    scopes = _open.__dict__.setdefault("scopes", [])
    mine: list[str] = []
    scopes.append(mine)
    try:
        yield Scratch(scopes)
    finally:
        scopes.pop()
        remove(spark, *mine)
