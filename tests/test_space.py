"""Nearest neighbours and similar pairs against plain programs, with limits forced small so every path is taken."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborseq.operators import pairs, spatial

from .test_sequences import branch

POINTS = "grp long, id long, x double, y double, z double"


def cloud(seed, n):
    """Points in clusters, on a lattice with ties, at one place, far apart; in groups of any size, one null."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.3:
            p = [rng.gauss(0, 0.001) for _ in range(3)]
        elif kind < 0.6:
            p = [float(rng.randrange(4)) for _ in range(3)]
        elif kind < 0.65:
            p = [7.0, 7.0, -0.0]
        else:
            p = [rng.uniform(-50, 50) for _ in range(3)]
        out.append((rng.choice([1, 1, 1, 2, None]) if i > 5 else 3, i, *p))
    return out


def brute_nearest(points, nodes, k):
    out = {}
    for g, i, *p in points:
        d = sorted((sum((a - b) ** 2 for a, b in zip(p, q, strict=True)), j) for h, j, *q in nodes if h == g)[:k]
        out.update({(g, i, r): (j, x**0.5) for r, (x, j) in enumerate(d, 1)})
    return out


def same(got, want):
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


@pytest.mark.parametrize("seed, k, most, small", [(0, 6, 8, 16), (1, 1, 3, 0), (2, 6, None, 1024)])
def test_k_nearest(spark, seed, k, most, small, monkeypatch):
    monkeypatch.setattr(spatial, "UNIT", 50)  # large cubes are dealt out in units
    rows = cloud(seed, 400)
    odd = [(1, 9001, None, 0.0, 0.0), (1, 9002, float("nan"), 0.0, 0.0), (1, 9003, float("inf"), 0.0, 0.0)]
    got = spatial.k_nearest(spark.createDataFrame(rows + odd, POINTS), k, most=most, small=small)
    assert got.columns == ["grp", "id", "rank", "neighbour", "distance"]
    same({(r.grp, r.id, r["rank"]): (r.neighbour, r.distance) for r in got.collect()}, brute_nearest(rows, rows, k))


@pytest.mark.parametrize("most, small", [(4, 10), (None, 1024)])
def test_snap(spark, most, small):
    points, nodes = cloud(5, 250), [r for r in cloud(6, 300) if r[0] != 3]
    got = spatial.snap(spark.createDataFrame(points, POINTS), spark.createDataFrame(nodes, POINTS).withColumnRenamed("id", "node_id"), most=most, small=small)
    same({(r.grp, r.id, 1): (r.node_id, r.distance) for r in got.collect()}, brute_nearest(points, nodes, 1))


def test_nothing_is_near_nothing(spark):
    none = spark.createDataFrame([], POINTS)
    assert spatial.k_nearest(none, 3).count() == 0
    assert spatial.snap(none, spark.createDataFrame(cloud(1, 9), POINTS).withColumnRenamed("id", "node_id")).count() == 0
    assert spatial.snap(spark.createDataFrame(cloud(1, 9), POINTS), none.withColumnRenamed("id", "node_id")).count() == 0


def test_one_large_group(spark):
    """A group of 30,000 points, a third of them in a tiny cluster and a third at one place."""
    rng = np.random.default_rng(2)
    xyz = rng.uniform(-100, 100, (30_000, 3))
    xyz[10_000:20_000] /= 1e6
    xyz[20_000:] = 3.0
    rows = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(xyz)], POINTS)
    got = spatial.k_nearest(rows, 4)
    asked = got.where("id % 997 = 5").collect()
    assert got.count() == 120_000
    for i in {r.id for r in asked}:
        d = ((xyz - xyz[i]) ** 2).sum(1)
        want = np.lexsort((np.arange(len(d)), d))[:4].tolist()
        assert [r.neighbour for r in sorted(asked, key=lambda r: r["rank"]) if r.id == i] == want


@pytest.mark.parametrize("k", [1, 2, 3, 4])
@pytest.mark.parametrize("patience", [0, 1e9])
def test_similar_pairs_whether_lists_are_extended_or_not(spark, k, patience):
    rng = random.Random(k)
    seqs = [[rng.choice([rng.randrange(4), rng.randrange(40)]) for _ in range(rng.randrange(1, 14))] for _ in range(30)]
    got = [(r.cell_a, r.cell_b, r.n_shared) for r in pairs.similar(branch(spark, *seqs), k, patience=patience).collect()]
    want = [(i, j, len(set(seqs[i]) & set(seqs[j]))) for i in range(30) for j in range(i + 1, 30)]
    assert sorted(got) == [p for p in want if p[2] >= k]


def test_branches_with_nothing_in_common_list_little(spark):
    """Postings grow with the branches' lengths, not with their squares, and lists of one branch go nowhere."""
    rows = spark.range(40 * 200).select(F.floor(F.col("id") / 200).alias("post_cell"), F.floor(F.col("id") / 200).alias("branch_id"), F.col("id").alias("pre_cell"))
    sets = pairs.by_rarity(pairs.cell_sets(rows))
    assert pairs.candidates(sets, 3).count() == 0 and pairs.similar(rows, 3).count() == 0


def test_sets_are_ordered_by_rarity(spark):
    sets = pairs.by_rarity(pairs.cell_sets(branch(spark, [1, 2, 9], [1, 2], [1, 3])))
    assert sorted((r.post_cell, r.s) for r in sets.collect()) == [(0, [9, 2, 1]), (1, [2, 1]), (2, [3, 1])]
