"""Written intermediate tables, so that a lost executor costs one read, not a rebuild."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: str | None = None  # of a session on one machine
_paths: list[tuple[SparkSession, str]] = []


def _folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; where that is unset, a temporary one if all runs on this machine."""
    global _local
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local is None:
        _local = tempfile.mkdtemp(prefix="braidwork-")
    return _local


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone
        pass


def drop_written() -> None:
    """Deletes all tables written so far; what was built on them cannot be read any more. Long sessions call it between jobs."""
    while _paths:
        _drop(*_paths.pop())


atexit.register(drop_written)


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for files that are dropped like written tables."""
    path = f"{_folder(spark).rstrip('/')}/braidwork-{name}-{uuid.uuid4().hex}"
    _paths.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back.

    This runs a job while the query is being built. The table is deleted by
    ``drop_written``, or when the driver ends.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
