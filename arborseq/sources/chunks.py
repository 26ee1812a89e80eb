"""A store that is filled chunk by chunk and taken up again where a run stopped.

Keys are dealt over numbered chunks.  A chunk's rows replace what its partition may hold of a run that was stopped, and
then a marker commits the chunk; only committed chunks are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import exists


def chunk_of(key: str, chunks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(chunks)).cast("int")


def committed(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the chunks that are whole; as many rows as there are chunks at most."""
    if not exists(spark, f"{path}/markers/_SUCCESS"):
        return []
    return sorted(r.chunk for r in spark.read.schema("chunk int").parquet(f"{path}/markers").distinct().collect())


def fill(wanted: DataFrame, path: str, key: str, compute: Callable[[DataFrame], DataFrame], chunks: int = 64, at_once: int = 8) -> int:
    """Compute and store the chunks of ``wanted`` that aren't committed, ``at_once`` in a job; returns how many were.

    ``compute`` maps rows of ``wanted`` to rows that still have ``key``.  ``chunks`` must be the same in every run.
    """
    spark = wanted.sparkSession
    left = [c for c in range(chunks) if c not in set(committed(spark, path))]
    for i in range(0, len(left), at_once):
        part = left[i : i + at_once]
        rows = compute(wanted.where(chunk_of(key, chunks).isin(part))).withColumn("chunk", chunk_of(key, chunks))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(f"{path}/rows")
        spark.createDataFrame([(c,) for c in part], "chunk int").coalesce(1).write.mode("append").parquet(f"{path}/markers")
    return len(left)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all committed chunks; other partitions aren't even listed in the scan."""
    rows = spark.read.parquet(f"{path}/rows")
    return rows.where(F.col("chunk").isin(committed(spark, path))).drop("chunk")
