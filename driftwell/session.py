"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder the session names; set one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        current = tempfile.mkdtemp(prefix="driftwell-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    The work before this point runs once and is never repeated when an executor is
    lost; the table's size on disk also tells the optimizer which joins may broadcast it.
    """
    path = f"{_SCRATCH.get() or ensure_checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """The file system that Spark reads ``path`` through, and the path in its terms."""
    named = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return named.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), named


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``cut_lineage`` writes inside are deleted at the end, also after an error.
    Frames that read them must not be used afterwards."""
    folder = f"{ensure_checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"
    before = _SCRATCH.set(folder)
    try:
        yield
    finally:
        _SCRATCH.reset(before)
        fs, path = file_system(spark, folder)
        fs.delete(path, True)
