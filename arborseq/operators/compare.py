"""Comparing sequences: common subsequence, common substring, overlap, edit distance.

The dynamic programs run over whole Arrow batches at once: pairs of similar
length are padded to one block, and a step handles a row of every pair's table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .sequences import ids, subsequence

#: Cells of a block of tables.
BLOCK = 4_000_000


def _padded(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(width)
    real = at < sizes[:, None]
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[real] = values[(starts[:, None] + at)[real]]
    return out, real


def blocks(a: pa.ListArray, b: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and their equality tables (rows x len a x len b), longest rows apart from short ones."""
    parts = []
    for x in (a, b):
        offsets = x.offsets.to_numpy()
        parts.append((x.values.to_numpy(zero_copy_only=False), offsets[:-1].astype(np.int64), np.diff(offsets).astype(np.int64)))
    (va, sa, na), (vb, sb, nb) = parts
    order = np.lexsort((nb, na))
    i = 0
    while i < len(order):
        size = max(1, BLOCK // max(1, int((na[order[i]] + 1) * (nb[order[i]] + 1))))
        rows = order[i : i + size]
        while len(rows) > 1 and (na[rows].max() + 1) * (nb[rows].max() + 1) * len(rows) > 2 * BLOCK:
            rows = rows[: len(rows) // 2]
        i += len(rows)
        xa, ra = _padded(va, sa[rows], na[rows], int(na[rows].max(initial=0)))
        xb, rb = _padded(vb, sb[rows], nb[rows], int(nb[rows].max(initial=0)))
        yield rows, (xa[:, :, None] == xb[:, None, :]) & ra[:, :, None] & rb[:, None, :]


def lcs_tables(equal: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of all suffixes."""
    n, p, q = equal.shape
    t = np.zeros((n, p + 1, q + 1), dtype=np.int32)
    for i in range(p - 1, -1, -1):
        step = np.where(equal[:, i], t[:, i + 1, 1:] + 1, t[:, i + 1, :-1])
        t[:, i, :-1] = np.maximum.accumulate(step[:, ::-1], axis=1)[:, ::-1]
    return t


def trace(equal: np.ndarray, t: np.ndarray) -> tuple[list[int], list[int]]:
    """The first longest common subsequence: at each step the least place in a, then in b, that leaves the rest possible."""
    left, i, j, out_a, out_b = int(t[0, 0]), 0, 0, [], []
    while left:
        hit = np.flatnonzero(equal[i, j:] & (t[i + 1, j + 1 :] == left - 1))
        if len(hit):
            j += int(hit[0])
            out_a.append(i)
            out_b.append(j)
            j += 1
            left -= 1
        i += 1
    return out_a, out_b


def _lcs(a: pa.Array, b: pa.Array, least: int) -> pa.Array:
    score = np.zeros(len(a), dtype=np.int32)
    places: dict[int, tuple[list[int], list[int]]] = {}
    for rows, equal in blocks(a, b):
        t = lcs_tables(equal)
        score[rows] = t[:, 0, 0]
        for k in np.flatnonzero(t[:, 0, 0] >= least):
            places[int(rows[k])] = trace(equal[k], t[k])
    kind = pa.list_(pa.int32())
    return pa.StructArray.from_arrays(
        [pa.array(score)] + [pa.array([places[r][s] if r in places else None for r in range(len(a))], kind) for s in (0, 1)], names=["score", "idx_a", "idx_b"]
    )


def _lcs_length(a: pa.Array, b: pa.Array) -> pa.Array:
    score = np.zeros(len(a), dtype=np.int32)
    for rows, equal in blocks(a, b):
        n, p, q = equal.shape
        row = np.zeros((n, q + 1), dtype=np.int32)
        for i in range(p - 1, -1, -1):
            step = np.where(equal[:, i], row[:, 1:] + 1, row[:, :-1])
            row[:, :-1] = np.maximum.accumulate(step[:, ::-1], axis=1)[:, ::-1]
        score[rows] = row[:, 0]
    return pa.array(score)


def _substring(a: pa.Array, b: pa.Array) -> pa.Array:
    best, at_a, at_b = (np.zeros(len(a), dtype=np.int32) for _ in range(3))
    for rows, equal in blocks(a, b):
        n, p, q = equal.shape
        run = np.zeros((n, q + 1), dtype=np.int32)
        top, ia, ib = (np.zeros(n, dtype=np.int32) for _ in range(3))
        for i in range(p - 1, -1, -1):
            run[:, :-1] = np.where(equal[:, i], run[:, 1:] + 1, 0)
            j = run.argmax(axis=1)
            m = run[np.arange(n), j]
            better = (m >= top) & (m > 0)
            top[better], ia[better], ib[better] = m[better], i, j[better]
        best[rows], at_a[rows], at_b[rows] = top, ia, ib
    return pa.StructArray.from_arrays([pa.array(x) for x in (best, at_a, at_b)], names=["score", "start_a", "start_b"])


def _levenshtein(a: pa.Array, b: pa.Array) -> pa.Array:
    out = np.zeros(len(a), dtype=np.int32)
    na, nb = np.diff(a.offsets.to_numpy()), np.diff(b.offsets.to_numpy())
    for rows, equal in blocks(a, b):
        n, p, q = equal.shape
        at = np.arange(q + 1, dtype=np.int32)
        row = np.tile(at, (n, 1))
        out[rows] = np.where(na[rows] == 0, nb[rows], out[rows])
        for i in range(p):
            new = np.empty_like(row)
            new[:, 0] = i + 1
            new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + ~equal[:, i])
            row = np.minimum.accumulate(new - at, axis=1) + at
            done = na[rows] == i + 1
            out[rows[done]] = row[done, nb[rows[done]]]
    return pa.array(out)


def lcs(spark: SparkSession, a: Column, b: Column, least: int = 3) -> Column:
    """struct(score, idx_a, idx_b) of two arrays of ids; places are null below ``least``, where no trace is made."""
    ship(spark)

    @F.arrow_udf("struct<score:int,idx_a:array<int>,idx_b:array<int>>")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return _lcs(x, y, least)

    return run(a, b)


def lcs_length(spark: SparkSession, a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays of ids, without looking for one."""
    ship(spark)

    @F.arrow_udf("int")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return _lcs_length(x, y)

    return run(a, b)


def substring(spark: SparkSession, a: Column, b: Column) -> Column:
    """struct(score, start_a, start_b) of the longest common substring; ties to the least start in a, then in b."""
    ship(spark)

    @F.arrow_udf("struct<score:int,start_a:int,start_b:int>")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return _substring(x, y)

    return run(a, b)


def edit_distance(spark: SparkSession, a: Column, b: Column) -> Column:
    """Levenshtein distance of two arrays of ids."""
    ship(spark)

    @F.arrow_udf("int")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return _levenshtein(x, y)

    return run(a, b)


def lcs_scores(pairs: DataFrame, least: int = 3, backwards: bool = False) -> DataFrame:
    """Pairs with seq_a, seq_b (nested): score, sub_a and sub_b, the matched elements; null below ``least``.

    ``backwards`` compares a with b read from its end.
    """
    spark = pairs.sparkSession
    if backwards:
        pairs = pairs.withColumn("seq_b", F.reverse("seq_b"))
    out = pairs.withColumn("_lcs", lcs(spark, ids("seq_a"), ids("seq_b"), least))
    return out.withColumn("score", F.col("_lcs.score")).withColumn("sub_a", subsequence("seq_a", F.col("_lcs.idx_a"))).withColumn("sub_b", subsequence("seq_b", F.col("_lcs.idx_b"))).drop("_lcs")


def substring_scores(pairs: DataFrame, least: int = 3) -> DataFrame:
    """As ``lcs_scores``, for the longest common substring."""
    out = pairs.withColumn("_s", substring(pairs.sparkSession, ids("seq_a"), ids("seq_b"))).withColumn("score", F.col("_s.score"))
    for side in "ab":
        cut = F.slice(F.col(f"seq_{side}"), F.col(f"_s.start_{side}") + 1, F.col("score"))
        out = out.withColumn(f"sub_{side}", F.when(F.col("score") >= least, cut))
    return out.drop("_s")


def cluster_scores(pairs: DataFrame, least: int = 2) -> DataFrame:
    """score: number of distinct cells in common; sub_a, sub_b: each side's elements of those cells, in order; null below ``least``."""
    out = pairs.withColumn("_common", F.array_intersect(ids("seq_a"), ids("seq_b"))).withColumn("score", F.size("_common"))
    for side in "ab":
        out = out.withColumn(f"sub_{side}", F.when(F.col("score") >= least, F.filter(f"seq_{side}", lambda e: F.array_contains(F.col("_common"), e["pre_cell"]))))
    return out.drop("_common")
