"""Settings and shared folders of a session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_kept: list[DataFrame] = []
_written: list[tuple[SparkSession, str]] = []


def kept(rows: DataFrame) -> DataFrame:
    """Rows that a plan reads more than once, kept on the executors until ``release``; lost blocks are computed again."""
    _kept.append(rows.persist(StorageLevel.MEMORY_AND_DISK))
    return _kept[-1]


def written(rows: DataFrame, name: str) -> DataFrame:
    """Rows written to a new folder below the shared one and read again: their lineage ends there, whatever executor is lost later."""
    spark, path = rows.sparkSession, shared_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(rows.schema).parquet(path)


def release() -> int:
    """Let go of all that operators have kept or written, once their results are written; how many tables that were."""
    n = len(_kept) + len(_written)
    while _kept:
        _kept.pop().unpersist()
    while _written:
        spark, path = _written.pop()
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return n


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that all executors share, ``spark.checkpoint.dir``.

    Where that is unset a temporary folder is made in local mode, as in tests; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        base = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
