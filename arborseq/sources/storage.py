"""Intermediate tables in the storage that all executors share."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; only a local session may have none, and gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        base = "file://" + os.path.join(tempfile.gettempdir(), "arborseq-shared")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet and read back: lineage ends there, its shuffle files go, and a lost executor costs only the tasks it ran.

    What rounds need again and again is stored; it stays until ``discard``, or as the storage's lifecycle rule says.
    """
    spark = df.sparkSession
    path = shared_dir(spark, label)
    with shuffles_cleaned(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


@contextlib.contextmanager
def shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """Jobs started here remove their shuffle files when they end, not when the driver next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(*frames: DataFrame) -> None:
    """Delete ``stored`` tables that nothing reads any more."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
