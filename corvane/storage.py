"""Shared intermediate storage.

Lineage is cut by writing Parquet to the folder that ``spark.checkpoint.dir`` names, which every
executor and the driver can reach. Lost executors then cost a re-read, not a re-computation, and
columnar files are a fraction of the size of a serialised row checkpoint.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
#: Paths made inside the innermost :func:`scratch_scope`.
_MADE: ContextVar[list[str] | None] = ContextVar("corvane_scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the session's ``spark.checkpoint.dir``, or the context's
    checkpoint directory. Only a ``local`` master may fall back to a temporary folder, because there
    the driver and the executors are one process."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="corvane-")
    return "file://" + _LOCAL_DIRS[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below :func:`shared_dir`."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    made = _MADE.get()
    if made is not None:
        made.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what was put below :func:`shared_dir` inside; the results must have been written before."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        for path in made:
            discard(spark, path)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder once and return a scan of the written files."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch path that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
