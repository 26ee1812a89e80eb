"""Approximate nearest neighbours by a permutation index.

A bounded sample of vectors are pivots.  A vector's permutation is the order of
its nearest pivots; it is posted in the inverted files of the first ``post`` of
them, with its permutation's ``prefix``.  A query probes the files of its first
``probe`` pivots, ranks what it finds there by the footrule distance of the two
prefixes, and reranks the better part by the exact inner product.

Files of any length are cut into blocks of at most about ``block`` vectors, and a
file's queries likewise, so a pivot that is near to a third of all vectors is many
small tasks.  Of equal vectors only the k+1 smallest identifiers can be among a
query's k nearest, as ties go to the smaller one; further copies are left out
before they are dealt, which changes no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stored


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): rows with a key whose vector is not null or empty, holds no null or non-finite component, and isn't zero."""
    v = F.col(vector).cast("array<double>")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(key).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~odd & F.exists("v", lambda x: x != 0))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def permuted(rows: DataFrame, pivots: np.ndarray, prefix: int) -> DataFrame:
    """Add ``perm``: the numbers of the ``prefix`` nearest pivots, nearest first."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)  # at most max_pivots vectors

    def run(batches):
        p = shared.value
        for batch in batches:
            if batch.num_rows:
                near = np.argsort(-(matrix(batch.column(1)) @ p.T), axis=1, kind="stable")[:, :prefix]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1) * near.shape[1], pa.int32()), pa.array(near.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["id", "v", "perm"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, v array<double>, perm array<int>")


def footrule(query: np.ndarray, others: np.ndarray, n_pivots: int) -> np.ndarray:
    """Distance of one prefix from others; a pivot that a prefix lacks stands just behind it."""
    length = len(query)
    place = np.full(n_pivots, length, dtype=np.int16)
    place[query] = np.arange(length, dtype=np.int16)
    there = place.take(others)
    # pivots of the other prefix, at their place here or behind; then those of this one that the other lacks
    apart = np.abs(there - np.arange(length, dtype=np.int16)) + there
    return apart.sum(axis=1, dtype=np.int32) - length * length + length * (length + 1) // 2


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, largest first, ties to the smaller id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def search(vectors: DataFrame, every: int = 20, k: int = 20, key: str = "vec_id", vector: str = "embedding", max_pivots: int = 4096, post: int = 8, probe: int = 48, prefix: int = 48, keep: float = 0.5, least_kept: int = 256, block: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of every row whose key is divisible by ``every``.

    Nearness is the inner product in double precision.  The number of pivots is twice the root of the number of
    vectors, at most ``max_pivots``; ``keep`` is the part of a block's vectors that is reranked.  Where there are at
    most ``probe`` pivots, all files are probed.  Vectors whose length isn't the most common one take no part.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors, key, vector)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    kind = dict(rows.dtypes)["id"]
    if not sizes:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    dims = sizes[0]["d"]
    rows = stored(rows.where(F.size("v") == dims), "vectors")
    n = rows.count()
    copies = Window.partitionBy("v").orderBy("id")
    candidates = stored(rows.withColumn("_n", F.row_number().over(copies)).where(F.col("_n") <= k + 1), "candidates")
    n_pivots = min(max_pivots, max(1, int(2 * n**0.5)))
    sample = candidates.where("_n = 1").select("v", "id", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(n_pivots)
    pivots = np.array([r["v"] for r in sample.select("v").collect()])
    prefix = min(prefix, len(pivots))
    posted = stored(permuted(candidates.select("id", "v"), pivots, prefix), "postings")
    asked = stored(permuted(rows.where(F.pmod("id", F.lit(every)) == 0), pivots, prefix), "queries")
    vec_files = posted.select("id", "v", "perm", F.explode(F.slice("perm", 1, post)).alias("pivot"))
    query_files = asked.select("id", "v", "perm", F.explode(F.slice("perm", 1, probe)).alias("pivot"))
    counts = (
        vec_files.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("vec_blocks"))
        .join(query_files.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("query_blocks")), "pivot")
    )
    counts = stored(counts, "file-sizes")  # a row for each pivot

    def part(of: str):
        return F.pmod(F.xxhash64("id"), F.col(of)).cast("int")

    def every_part(of: str):
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

    left = vec_files.join(counts, "pivot").select("pivot", part("vec_blocks").alias("vb"), every_part("query_blocks").alias("qb"), "id", "v", "perm")
    right = query_files.join(counts, "pivot").select("pivot", every_part("vec_blocks").alias("vb"), part("query_blocks").alias("qb"), "id", "v", "perm")
    n_pivots = len(pivots)
    kind_out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def probe_block(file: pa.Table, queries: pa.Table) -> pa.Table:
        if not file.num_rows or not queries.num_rows:
            return kind_out.empty_table()
        ids, vs, perms = file["id"].to_numpy(), matrix(file["v"]), matrix(file["perm"]).astype(np.intp)
        order = np.argsort(ids, kind="stable")
        ids, vs, perms = ids[order], vs[order], perms[order]
        qids, qs, qperms = queries["id"].to_numpy(), matrix(queries["v"]), matrix(queries["perm"])
        most = max(least_kept, k + 1, int(keep * len(ids)))
        found = []
        for i, q in enumerate(qids):
            at = np.arange(len(ids))
            if most < len(ids):
                far = footrule(qperms[i], perms, n_pivots)
                at = np.argpartition(far, most - 1)[:most]
            at = at[ids[at] != q]
            scores = np.einsum("ij,j->i", vs.take(at, axis=0), qs[i])
            top = best_of(ids[at], scores, k)
            found.append((np.full(len(top), q), ids[at[top]], scores[top]))
        return pa.table([np.concatenate(x) for x in zip(*found, strict=True)], schema=kind_out)

    met = left.groupBy("pivot", "vb", "qb").cogroup(right.groupBy("pivot", "vb", "qb")).applyInArrow(probe_block, "query_id long, vec_id long, score double")
    once = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = once.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    return out.select(F.col("query_id").cast(kind), "rank", F.col("vec_id").cast(kind), "score")
