"""Intermediate tables in the folder that all executors share.

Writing a narrow table and reading it again cuts the lineage, so a lost executor costs a re-read and
not a recomputation, and several consumers can use one pass over the text. The folder is
``spark.checkpoint.dir``. Where that is unset, a local session (tests) gets a temporary folder that is
removed at exit and a cluster session uses the warehouse, which is shared too. Tables written to the
configured folder stay until the application's folder ``lakewarden-<application id>`` is removed,
because the lazily evaluated result of a query still reads them; :func:`release` removes it. What a block under
:func:`scope` writes lies in a folder of its own, which :func:`drop` removes when its result has been written.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Rows that go to a Python worker at a time. The default of 10,000 texts takes some 150 MB more in each worker.
BATCH_ROWS = 1000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"

_local: dict[str, str] = {}
_scope: ContextVar[str] = ContextVar("scratch_scope", default="")


def root(spark: SparkSession) -> str:
    """The application's folder for intermediate tables, as a URI or path that every executor can open."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if context.master.startswith("local") and not context.master.startswith("local-cluster"):
            if context.applicationId not in _local:
                _local[context.applicationId] = tempfile.mkdtemp(prefix="lakewarden-")
                atexit.register(shutil.rmtree, _local[context.applicationId], ignore_errors=True)
            base = _local[context.applicationId]
        else:
            base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/lakewarden-{context.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_scope.get() or root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@contextlib.contextmanager
def scope(spark: SparkSession, name: str) -> Iterator[str]:
    """The folder of all tables that the block writes."""
    folder = new_path(spark, name)
    token = _scope.set(folder)
    try:
        yield folder
    finally:
        _scope.reset(token)


def small_batches(spark: SparkSession) -> None:
    """Send whole texts to Python ``BATCH_ROWS`` at a time, unless the session has a number of its own."""
    if spark.conf.get(_BATCH_SETTING) == "10000":
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads the written table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Remove a table or a scope's folder; what still reads it can't be read after that."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Remove every intermediate table of this application; earlier results can't be read after it."""
    drop(spark, root(spark))
