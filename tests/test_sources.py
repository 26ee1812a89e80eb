"""The resumable store, stopped midway."""

import pytest
from pyspark.sql import functions as F

from arborseq.sources import chunks


def test_a_stopped_run_goes_on_at_the_missing_chunks(spark, tmp_path):
    path, keys = f"file://{tmp_path}/store", spark.range(100).withColumnRenamed("id", "key")
    asked = []

    def compute(rows, fail_from=99):
        asked.append(rows.count())
        if len(asked) > fail_from:
            # half of a chunk's rows are written before the run stops
            some = rows.where("key % 2 = 0").withColumn("v", F.lit(-1).cast("long")).withColumn("chunk", chunks.chunk_of("key", 10))
            some.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(f"{path}/rows")
            raise RuntimeError("stopped")
        return rows.withColumn("v", F.col("key") * 10)

    with pytest.raises(RuntimeError):
        chunks.fill(keys, path, "key", lambda r: compute(r, fail_from=2), chunks=10, at_once=3)
    half = chunks.read(spark, path)
    assert len(chunks.committed(spark, path)) == 6
    assert half.where("v <> key * 10").count() == 0 and half.count() == sum(asked[:2])
    assert chunks.fill(keys, path, "key", compute, chunks=10, at_once=3) == 4
    whole = chunks.read(spark, path)
    assert sorted((r.key, r.v) for r in whole.collect()) == [(i, 10 * i) for i in range(100)]
    assert chunks.fill(keys, path, "key", compute, chunks=10, at_once=3) == 0
