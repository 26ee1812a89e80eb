import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborseq.functions import normal
from arborseq.operators import mixture, pairs, sequences, shuffles, spatial, stats, trees
from arborseq.plans import experiment
from arborseq.sources import fixtures, storage, tables
from tests.test_sequences import branch


def long_branches(spark, n=30):
    rng = random.Random(0)
    rows = [(b, b, i, 100 * b + i, rng.randrange(9), rng.choice("AB"), float(i), 0.0, 0.0) for b in range(n) for i in range(rng.randrange(1, 9))]
    return sequences.nested(spark.createDataFrame(rows, "post_cell long, branch_id long, seq_pos int, syn_id long, pre_cell long, cell_type string, x double, y double, z double"))


@pytest.mark.parametrize("model", ["random", "type"])
def test_shuffles_move_inputs_only(spark, model):
    branches = long_branches(spark)
    before = {r.branch_id: r.seq for r in branches.collect()}
    rows = shuffles.shuffle(branches, model, 3, 1).collect()
    assert len(rows) == 3 * len(before)
    moved = 0
    for r in rows:
        old = before[r.branch_id]
        assert sorted(e.syn_id for e in r.seq) == sorted(e.syn_id for e in old)
        assert [e.x for e in r.seq] == [e.x for e in old]
        moved += [e.syn_id for e in r.seq] != [e.syn_id for e in old]
        if model == "type":
            assert [e.cell_type for e in r.seq] == [e.cell_type for e in old]
    assert moved
    again = shuffles.shuffle(branches.repartition(7), model, 3, 1).collect()
    assert {(r.trial, r.branch_id): r.seq for r in rows} == {(r.trial, r.branch_id): r.seq for r in again}


def test_original_and_unknown_models(spark):
    branches = long_branches(spark, 3)
    assert shuffles.shuffle(branches, "original", 9).count() == 3
    with pytest.raises(ValueError):
        shuffles.shuffle(branches, "other")
    with pytest.raises(ValueError):
        shuffles.shuffle(branches, "axon")


def test_draw_without_replacement():
    def draw(scores, *u):
        return shuffles.draw_without_replacement(np.array(scores, dtype=float), np.array(u, dtype=float)).tolist()

    assert draw([[0.0, 1.0], [1.0, 0.0]], [0.5, 0.5], [0.0, 0.9]) == [[1, 0], [1, 0]]
    assert sorted(draw(np.zeros((4, 4)), [0.9, 0.1, 0.5, 0.7])[0]) == [0, 1, 2, 3]
    assert sorted(draw(np.full((3, 3), np.nan), [0.999, 0.999, 0.999])[0]) == [0, 1, 2]
    assert draw([[1.0, 3.0], [1.0, 1.0]], [0.24, 0.5], [0.26, 0.5]) == [[0, 1], [1, 0]]


def plain_truncated(mu, sigma, u):
    if mu is None or mu != mu:
        return u
    clamped = min(1.0, max(0.0, mu))
    if sigma is None or not sigma > 0:
        return clamped
    low, high = (0.5 * math.erfc((mu - x) / sigma / math.sqrt(2)) for x in (0.0, 1.0))
    p = low + u * (high - low)
    if not 0 < p < 1 or high - low < 1e-12:
        return clamped
    return min(1.0, max(0.0, NormalDist(mu, sigma).inv_cdf(p)))


def test_truncated_normal(spark):
    draws = [(m, s, u) for m in (-3.0, -0.2, 0.0, 0.5, 0.9, 1.4, 40.0) for s in (0.0, 1e-3, 0.05, 0.2, 1.0, 7.0, 1e4) for u in (0.0, 1e-6, 0.01, 0.3, 0.5, 0.77, 0.999999)]
    draws += [(None, None, 0.25), (float("nan"), 1.0, 0.5), (0.4, None, 0.1), (2.0, float("nan"), 0.1)]
    df = spark.createDataFrame([(draws,), (None,)], "d array<struct<mu double, sigma double, u double>>")
    got = [r[0] for r in df.select(normal.truncated(df.d)).collect()]
    assert got[1] is None
    for d, v in zip(draws, got[0], strict=True):
        assert math.isclose(v, plain_truncated(*d), abs_tol=1e-6), d
    even = spark.createDataFrame([([(0.5, 0.2, (i + 0.5) / 1000) for i in range(1000)],)], df.schema)
    values = even.select(normal.truncated(F.col("d"))).first()[0]
    assert abs(np.mean(values) - 0.5) < 0.01 and min(values) >= 0 and max(values) <= 1


def test_clean_probs(spark):
    df = spark.createDataFrame([([float("nan"), -1.0, 3.0, 1.0],), ([0.0, None],)], "p array<double>")
    assert [r[0] for r in df.select(shuffles.clean_probs(df.p)).collect()] == [[0.0, 0.0, 0.75, 0.25], [0.5, 0.5]]


def test_planted_sequence_stands_out_and_noise_does_not(spark):
    rng = random.Random(3)
    planted = [[rng.randrange(200) for _ in range(2)] + [1, 2, 3, 4] + [rng.randrange(200)] for _ in range(30)]
    z = {r["shuffle"]: r for r in experiment.z_scores(experiment.null_counts(branch(spark, *planted), ["original", "random"], 5)).collect()}
    assert z["random"]["real"] < z["random"]["mean"]  # one sequence repeats, instead of many different ones
    one = experiment.z_scores(experiment.null_counts(branch(spark, *planted), ["original", "random"], 1)).first()
    assert one["z"] is None


def test_histograms(spark):
    df = spark.createDataFrame([(v,) for v in [0.0, 1.0, 2.0, 5.0, 10.0, 10.0, 11.0]], "v double")
    assert {r.bin: r.n for r in stats.histogram(df.where("v <= 10"), "v", bins=5).collect()} == {0: 2, 1: 1, 2: 1, 4: 2}
    assert {r.bin: r.n for r in stats.histogram(df, "v", [1, 2, 10]).collect()} == {0: 1, 1: 4}
    assert {r.bin: r.n for r in stats.histogram(df.where("v = 1"), "v").collect()} == {0: 1}
    edges = stats.log_edges(0.08, 30, 30)
    assert len(edges) == 30 and edges[0] == 0.08 and edges[-1] == 30 and all(abs(b / a - edges[1] / edges[0]) < 1e-9 for a, b in zip(edges, edges[1:], strict=False))


def test_ecdf_keeps_ties_apart(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 2.0), (2, 7.0)], "g int, v double")
    assert sorted(map(tuple, stats.ecdf(df, "v").collect())) == [(2.0, 25.0), (5.0, 50.0), (5.0, 75.0), (7.0, 100.0)]
    assert sorted(map(tuple, stats.ecdf(df, "v", ["g"]).where("g = 2").collect())) == [(2, 7.0, 100.0)]


NODES = "cell_id long, node_id long, parent_id long, x double, y double, z double, cell_type string, pre_cell long, syn_id long"


def tree(spark, parents, types=None, cell=0, at=None):
    rows = [(cell, n, p, *(at or {}).get(n, (float(n), 0.0, 0.0)), (types or {}).get(n, "A"), n, n) for n, p in parents.items()]
    return spark.createDataFrame(rows, NODES)


FORK = {1: -1, 2: 1, 3: 2, 4: 2, 5: 4}


def test_paths_and_orders(spark):
    nodes = tree(spark, FORK)
    got = {r.node_id: (r.path_id, r.pos) for r in trees.paths(nodes).collect()}
    assert got == {1: (2, 0), 2: (2, 1), 3: (3, 0), 4: (5, 0), 5: (5, 1)}
    dup = sorted((r.path_id, r.pos, r.node_id) for r in trees.paths(nodes, True).collect())
    assert dup == [(2, 0, 1), (2, 1, 2), (3, 0, 2), (3, 1, 3), (5, 0, 2), (5, 1, 4), (5, 2, 5)]
    m = {r.node_id: (r.depth, r.n_children, r.strahler) for r in trees.measured(nodes).collect()}
    assert m == {1: (1, 1, 2), 2: (2, 2, 2), 3: (3, 0, 1), 4: (3, 1, 1), 5: (4, 0, 1)}
    assert {r.node_id for r in trees.leaves(nodes).collect()} == {3, 5}
    assert sorted((r.leaf_id, r.path) for r in trees.root_paths(nodes).collect()) == [(3, [-1, 1, 2, 3]), (5, [-1, 1, 2, 4, 5])]


def test_contraction_and_pruning(spark):
    types = {4: "Unknown", 5: "Unknown", 1: "Unknown"}
    nodes = tree(spark, FORK, types)
    assert {r.node_id for r in trees.prune_unknown(nodes).collect()} == {1, 2, 3}
    assert {(r.node_id, r.parent_id) for r in trees.excitatory(nodes).collect()} == {(2, -1), (3, 2)}
    kept = trees.contract(nodes, trees.F.col("node_id").isin(5, 3), branching=False)
    assert {(r.node_id, r.parent_id) for r in kept.collect()} == {(3, -1), (5, -1)}
    assert {(r.head_id, r.parent_head_id, r.tail_id) for r in trees.coarse(nodes).collect()} == {(1, -1, 2), (3, 1, 3), (4, 1, 5)}


def test_deep_trees_and_missing_parents(spark):
    n = 3000
    deep = trees.measured(tree(spark, {i: i - 1 if i > 1 else -1 for i in range(1, n + 1)}))
    assert deep.agg({"depth": "max"}).first()[0] == n
    with pytest.raises(Exception, match="parent is missing"):
        trees.measured(tree(spark, {2: 1})).collect()


def test_smoothing_keeps_nodes_and_ends_without_short_twigs(spark):
    nodes = tree(spark, {1: -1, 2: 1, 3: 1, 4: 3, 5: 4, 6: 5, 7: 6}, at={2: (1.5, 1.0, 0.0)})
    out = trees.smooth(nodes, 2).collect()
    assert sorted(r.node_id for r in out) == [1, 2, 3, 4, 5, 6, 7]
    parents = [r.parent_id for r in out]
    assert max(parents.count(p) for p in parents) == 1


def brute_tree_distance(a, b):
    """Edit distance of ordered forests given as tuples (label, children), by the plain recursion."""
    from functools import cache

    def size(f):
        return sum(1 + size(c) for _, c in f)

    @cache
    def d(f, g):
        if not f or not g:
            return size(f) + size(g)
        (x, cx), (y, cy) = f[-1], g[-1]
        return min(d(f[:-1] + cx, g) + 1, d(f, g[:-1] + cy) + 1, d(f[:-1], g[:-1]) + d(cx, cy) + (x != y))

    return d(a, b)


def test_tree_distance_matches_the_recursion():
    rng = random.Random(1)

    def random_tree(n):
        return list(range(1, n + 1)), [-1 if i == 1 else rng.choice([-1, *range(1, i)]) for i in range(1, n + 1)]

    def forest(ids, parents, top=-1):
        return tuple((i, forest(ids, parents, i)) for i, p in sorted(zip(ids, parents, strict=True)) if p == top)

    for _ in range(40):
        a, b = random_tree(rng.randrange(1, 7)), random_tree(rng.randrange(1, 7))
        assert trees.tree_distance(a, b) == brute_tree_distance(((-1, forest(*a)),), ((-1, forest(*b)),))


def test_segment_distribution_matches_sampling(spark):
    """The closed form along a line is the conditional normal: compared on a grid."""
    cov = np.array([[4.0, 1.0, 0.5], [1.0, 3.0, 0.2], [0.5, 0.2, 2.0]])
    P = np.linalg.inv(cov)
    row = [(9, 0, 1.0, 1.0, 2.0, 3.0, *[float(P["xyz".index(k[0]), "xyz".index(k[1])]) for k in mixture.SIX], float(np.linalg.det(P)))]
    mix = spark.createDataFrame(row, "cell_id long, comp long, weight double, mx double, my double, mz double, " + ", ".join(f"p_{k} double" for k in mixture.SIX) + ", det double")
    pos = [(0.0, 0.0, 0.0), (2.0, 1.0, 0.5), (1.0, 3.0, 2.0)]
    rows = spark.createDataFrame([(1, 1, i, i, 9, "A", *p) for i, p in enumerate(pos)], "post_cell long, branch_id long, seq_pos int, syn_id long, pre_cell long, cell_type string, x double, y double, z double")
    got = {(r.i, r.seg): r for r in mixture.segment_probs(rows, mix).collect()}
    assert len(got) == 6
    o, v = np.array(pos[0]), np.array(pos[1]) - np.array(pos[0])
    t = np.linspace(-20, 20, 200001)
    w = np.exp(-0.5 * np.einsum("ni,ij,nj->n", o + t[:, None] * v - [1, 2, 3], P, o + t[:, None] * v - [1, 2, 3]))
    mean = (t * w).sum() / w.sum()
    assert math.isclose(got[0, 0].mu, mean, abs_tol=1e-6)
    assert math.isclose(got[0, 0].sigma, math.sqrt(((t - mean) ** 2 * w).sum() / w.sum()), abs_tol=1e-6)
    assert math.isclose(sum(got[0, s].prob for s in (0, 1)), 1.0)


def test_em_finds_two_clusters():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (200, 3)), rng.normal(8, 1, (100, 3))])
    w, m, _, _ = mixture.expectation_maximisation(x, np.array([0.5, 0.5]), np.array([[1.0, 1, 1], [6.0, 6, 6]]), np.stack([np.eye(3)] * 2))
    assert abs(w[0] - 2 / 3) < 0.01 and abs(m[1].mean() - 8) < 0.3


def test_radius_join_matches_all_pairs(spark):
    rng = random.Random(2)
    pts = [(i, *[rng.uniform(-3, 3) for _ in range(3)]) for i in range(60)]
    df = spark.createDataFrame(pts, "id long, x double, y double, z double")
    got = {(r.id_a, r.id_b) for r in spatial.within(df, df, 1.1).collect()}
    assert got == {(a[0], b[0]) for a in pts for b in pts if math.dist(a[1:], b[1:]) <= 1.1}


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    tables.write_csv(df, f"{tmp_path}/csv")
    assert sorted(map(tuple, tables.csv(spark, f"{tmp_path}/csv", df.schema).collect())) == [(1, "a"), (2, "b")]
    calls = []

    def compute():
        calls.append(1)
        return df

    for _ in range(2):
        assert tables.cached(spark, f"{tmp_path}/cache", compute).count() == 2
    assert len(calls) == 1
    assert [r.k for r in tables.missing(df, df.where("k = 1"), "k").collect()] == [2]
    trials = spark.createDataFrame([("random", 0, 1), ("random", 1, 2), ("type", 0, 3)], "shuffle string, trial int, n int")
    tables.write_trials(trials, f"{tmp_path}/trials")
    assert [r.n for r in tables.read_trials(spark, f"{tmp_path}/trials", "random", 1).collect()] == [2]
    with pytest.raises(ValueError):
        tables.scan(df, limit=1)
    assert tables.last_wins(df.withColumn("o", df.k).union(df.withColumn("o", df.k + 5)), ["k"], ["o"]).where("o < 5").count() == 0


def test_fit_in_rounds_equals_fit_in_tasks(spark):
    """Cells that converge soon and late, one with a single point, one without points, one without a mixture."""
    rng = np.random.default_rng(8)
    rows = []
    for cell, spread in ((1, 0.4), (2, 2.0), (3, 0.01)):
        for path, at in enumerate(([0, 0, 0], [4, 4, 1], [0, 5, 9])):
            rows += [(cell, path, *map(float, rng.normal(at, spread, 3))) for _ in range(25 * cell)]
    rows += [(4, 0, 1.0, 2.0, 3.0), (5, 0, 1.0, 1.0, 1.0)]
    points = spark.createDataFrame(rows, "cell_id long, path_id long, x double, y double, z double")
    start = mixture.path_moments(points).where("cell_id <> 5").unionByName(mixture.path_moments(points.where("cell_id = 4")).withColumn("cell_id", mixture.F.lit(6).cast("long")))
    start = start.withColumn("mx", mixture.F.col("mx") + 0.7).withColumn("mz", mixture.F.col("mz") - 0.5)
    key = ["cell_id", "comp"]
    want = {(r.cell_id, r.comp): r for r in mixture.fit(points, start).collect()}
    for got in (mixture.fit_in_rounds(points, start), mixture.fit(points, start, in_task=60)):
        got = {(r.cell_id, r.comp): r for r in got.collect()}
        assert set(got) == set(want) and {c for c, _ in got} == {1, 2, 3, 4}
        for k, r in got.items():
            for n in ("weight", "mx", "my", "mz", "log_likelihood", *[f"p_{e}" for e in mixture.SIX], "det"):
                assert np.isclose(r[n], want[k][n], rtol=1e-4, atol=1e-4), (k, n)
    assert [f.name for f in mixture.fit(points, start).schema] == [*key, "weight", "mx", "my", "mz", *[f"p_{e}" for e in mixture.SIX], "det", "log_likelihood"]


def test_only_branches_in_a_pair_are_shuffled(spark):
    rows = branch(spark, [1, 2, 3], [3, 2, 1], [7, 8, 9], [1, 2, 9])
    found = pairs.similar(rows, 3)
    assert {r.branch_id for r in experiment.paired(rows, found).collect()} == {0, 1}
    assert {r.shuffle: r.n for r in experiment.null_counts(branch(spark, [1, 2, 3], [1, 2, 3], [7, 8, 9]), ["original"], 1).collect()} == {"original": 1}


def test_tasks_of_the_sequence_view_grow_with_the_rows(spark, data, monkeypatch):
    monkeypatch.setattr(fixtures, "PER_TASK", 500)
    n = spark.read.parquet(f"{data}/lineitem.parquet").count()
    view = fixtures.seq_orders(spark, data)
    assert view.rdd.getNumPartitions() == sequences.nested(sequences.collapse(view)).rdd.getNumPartitions() == -(-n // 500)


def test_score_rows_add_the_components_of_each_cell(spark):
    points = spark.createDataFrame([(1, p, *(float((p * 7 + i * k) % 5) for k in (1, 2, 3))) for p in (0, 1) for i in range(6)], "cell_id long, path_id long, x double, y double, z double")
    m = mixture.path_moments(points)
    places = [(0.0, 1.0, 2.0), (3.0, 1.0, 0.0)]
    rows = spark.createDataFrame([(1, 10, places), (1, 11, places[:1]), (1, 12, []), (2, 10, places)], "cell_id long, b long, seq array<struct<x:double,y:double,z:double>>")
    got = {(r.cell_id, r.b): r.row for r in mixture.score_rows(rows, m).collect()}
    each = spark.createDataFrame([(1, i, *p) for i, p in enumerate(places)], "cell_id long, i long, x double, y double, z double")
    want = {r.i: r.p for r in mixture.weighted(each, m, ["i"]).groupBy("i").agg(mixture.F.sum("p").alias("p")).collect()}
    assert all(abs(v - want[i]) < 1e-12 for i, v in enumerate(got[1, 10])) and got[1, 11] == got[1, 10][:1] and got[1, 12] == [] and got[2, 10] == [0.0, 0.0]


def test_segments_of_nested_branches_equal_the_rows(spark):
    rng = random.Random(3)
    rows = [(b, b, i, 100 * b + i, rng.randrange(4), "A", float(rng.randrange(5)), float(rng.randrange(3)), 1.0) for b in range(30) for i in range(rng.randrange(1, 9))]
    rows = spark.createDataFrame(rows, "post_cell long, branch_id long, seq_pos int, syn_id long, pre_cell long, cell_type string, x double, y double, z double")
    mix = mixture.path_moments(rows.select(F.col("pre_cell").alias("cell_id"), (F.col("syn_id") % 3).alias("path_id"), *"xyz"))
    branches = sequences.nested(rows)
    want = {(r.branch_id, r.i, r.seg): (r.mu, r.sigma, r.prob) for r in mixture.segment_probs(rows, mix).collect()}
    got = {}
    for r in mixture.with_segments(branches, mix).collect():
        assert (r.segs is None) == (len(r.seq) < 3)
        got |= {(r.branch_id, i, k): tuple(e) for i, s in enumerate(r.segs or []) for k, e in enumerate(s)}
    assert got.keys() == want.keys() and len(got) > 100
    for k, w in want.items():
        assert all((a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)) for a, b in zip(got[k], w, strict=True)), k
    # cells without a mixture leave segments alike, and their inputs stay on the branch
    some = mixture.with_segments(branches, mix.where("cell_id > 0"))
    out = shuffles.continuous(some, 2).collect()
    before = {r.branch_id: sorted(e.syn_id for e in r.seq) for r in branches.collect()}
    assert len(out) == 2 * len(before) and all(sorted(e.syn_id for e in r.seq) == before[r.branch_id] for r in out)


def test_flattening_works_out_arrays_once(spark):
    made = long_branches(spark, 3).withColumn("seq", F.transform("seq", lambda e: e.withField("cell_type", F.md5(e["cell_type"]))))
    plan = sequences.flat(made)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1
    empty = made.select(*sequences.BRANCH, F.filter("seq", lambda e: F.lit(False)).alias("seq"))
    assert sequences.flat(empty).count() == 0


@pytest.mark.parametrize("limits", [{}, {"CHUNK": 2, "HELD": 3, "DEALT": 5, "SCORED": 4}])
def test_extended_scores_match_all_pairs(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(mixture, name, value)
    rng = random.Random(5)
    far = 1 << 60  # identifiers that doubles don't hold
    rows = [(far + b, far + b, i, 10 * b + i, far + rng.randrange(8), "A", *(float(rng.randrange(4)) for _ in "xyz")) for b in range(25) for i in range(rng.randrange(1, 6))]
    rows = spark.createDataFrame([*rows, (None, 1, 0, 999, far, "A", 1.0, 1.0, 1.0)], "post_cell long, branch_id long, seq_pos int, syn_id long, pre_cell long, cell_type string, x double, y double, z double")
    points = rows.where(F.col("pre_cell") < far + 7)  # one cell has no mixture
    m = mixture.path_moments(points.select(F.col("pre_cell").alias("cell_id"), (F.col("syn_id") % 3).alias("path_id"), *"xyz"))
    got = {(r.post_cell, r.branch_id, r.pre_cell, r.j): r.score for r in mixture.extended_scores(rows, rows, m, 1.0, log=False).collect()}
    every = [r for r in rows.collect() if r.post_cell is not None]
    comps = m.collect()

    def density(cell, at):
        return sum(c.weight * math.sqrt(c.det) * (2 * math.pi) ** -1.5 * math.exp(-0.5 * form(c, [at.x - c.mx, at.y - c.my, at.z - c.mz])) for c in comps if c.cell_id == cell)

    def form(c, d):
        return c.p_xx * d[0] ** 2 + c.p_yy * d[1] ** 2 + c.p_zz * d[2] ** 2 + 2 * (c.p_xy * d[0] * d[1] + c.p_xz * d[0] * d[2] + c.p_yz * d[1] * d[2])

    want = {}
    for b in {r.branch_id for r in every}:
        branch = [r for r in every if r.branch_id == b]
        near = {s.pre_cell for s in rows.collect() for r in branch if sum((r[k] - s[k]) ** 2 for k in "xyz") <= 1.0} - {r.pre_cell for r in branch}
        want |= {(r.post_cell, b, cell, r.seq_pos): density(cell, r) for cell in near for r in branch}
    assert got.keys() == want.keys() and len(want) > 100 and any(k[2] == far + 7 for k in want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_cells_near_a_place_are_listed_once(spark):
    rows = spark.createDataFrame([(b, b, c, 0.0, 0.0, 0.0) for b in range(30) for c in range(40)], "post_cell long, branch_id long, pre_cell long, x double, y double, z double")
    near = spatial.cells_within(rows, rows, 1.0, ["post_cell", "branch_id"], F.lit(0)).collect()
    assert len(near) == 30 and all(r.cells == list(range(40)) for r in near)


def test_moments_meet_by_path_before_they_are_summed(spark):
    points = spark.createDataFrame([(c, p, float(i), float(i * p), 1.0) for c in range(3) for p in range(2) for i in range(5)], "cell_id long, path_id long, x double, y double, z double")
    m = mixture.path_moments(points)
    assert "RebalancePartitions" in m._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.cell_id, r.comp): (r.weight, r.mx) for r in m.collect()} == {(c, p): (0.5, 2.0) for c in range(3) for p in range(2)}


@pytest.mark.parametrize("places", [[0, 1, 2], [3, 5, 9], [0]])
def test_score_matrix_keeps_places(spark, places):
    rows = spark.createDataFrame([(1, 1, i, i, 7 + i % 2, "A", float(i), 1.0, 2.0) for i in places], "post_cell long, branch_id long, seq_pos int, syn_id long, pre_cell long, cell_type string, x double, y double, z double")
    m = mixture.path_moments(rows.select(F.col("pre_cell").alias("cell_id"), F.lit(0).cast("long").alias("path_id"), *"xyz"))
    out = mixture.score_matrix(rows, m)
    assert out.schema["j"].dataType == rows.schema["seq_pos"].dataType
    got = {(r.i, r.j): r.score for r in out.collect()}
    each = rows.select(F.col("seq_pos").alias("j"), *"xyz").crossJoin(rows.select(F.col("seq_pos").alias("i"), F.col("pre_cell").alias("cell")))
    want = {(r.i, r.j): r.p for r in mixture.weighted(each, m, ["i", "j"], "cell").groupBy("i", "j").agg(F.sum("p").alias("p")).collect()}
    assert got.keys() == want.keys() == {(i, j) for i in places for j in places} and all(abs(got[k] - want[k]) < 1e-12 for k in want)


@pytest.mark.parametrize("limits", [(100_000, 4_000_000), (3, 20)])
def test_score_matrix_deals_a_branch_once_to_a_range_of_cells(spark, monkeypatch, limits):
    for name, most in zip(("HELD", "UNIT"), limits, strict=True):
        monkeypatch.setattr(mixture, name, most)
    monkeypatch.setattr(mixture, "SCORED", 7)  # rows of a branch come apart
    rng = random.Random(3)
    places = [(b % 5, b, i, rng.choice([-4, *range(9), 99, None]), float(rng.randrange(5)), float(rng.randrange(3)), 1.0) for b in range(25) for i in range(rng.randrange(1, 8))]
    rows = spark.createDataFrame(places, "post_cell long, branch_id long, seq_pos int, pre_cell long, x double, y double, z double")
    known = rows.where("pre_cell <> 99").select(F.col("pre_cell").alias("cell_id"), (F.col("x").cast("int") % 2).alias("path_id"), *"xyz")
    m = mixture.path_moments(known)
    out = mixture.score_matrix(rows, m)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Repartition") == 1
    got = {(r.branch_id, r.i, r.j): r.score for r in out.collect()}
    p = rows.alias("a").join(rows.alias("b"), "branch_id").select("branch_id", F.col("a.seq_pos").alias("i"), F.col("b.seq_pos").alias("j"), F.col("a.pre_cell").alias("cell"), *[F.col(f"b.{c}").alias(c) for c in "xyz"])
    want = {(r.branch_id, r.i, r.j): r.p for r in mixture.weighted(p, m, ["branch_id", "i", "j"], "cell").groupBy("branch_id", "i", "j").agg(F.sum("p").alias("p")).collect()}
    assert got.keys() == {(r.branch_id, r.i, r.j) for r in p.collect()} and len(want) < len(got) == out.count()
    assert all(abs(v - want.get(k, 0.0)) < 1e-12 for k, v in got.items())


def test_stored_tables_leave_no_shuffle_files(spark):
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false")
    status = spark.sparkContext._jsc.sc().env().mapOutputTracker()
    held = status.shuffleStatuses().size()
    out = storage.stored(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count(), "t")
    assert status.shuffleStatuses().size() <= held
    assert out.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == before


def mixed_branches(spark):
    rng = random.Random(5)
    rows = [(b % 3, b // 2, 2 * i, 100 * b + i, rng.choice([0, 1, 2, 3, None]), "A", float(rng.randrange(5)), float(rng.randrange(3)), 1.0) for b in range(24) for i in range(rng.randrange(1, 7))]
    rows = spark.createDataFrame(rows, "post_cell long, branch_id long, seq_pos int, syn_id long, pre_cell long, cell_type string, x double, y double, z double")
    known = rows.where("pre_cell > 0")
    return rows, mixture.path_moments(known.select(F.col("pre_cell").alias("cell_id"), (F.col("syn_id") % 3).alias("path_id"), *"xyz"))


def dealt_once(df) -> bool:
    """Whether branches are shuffled whole, once, and neither joined nor put together again."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("Repartition") == 1 and plan.count("Join ") == 1 and "Aggregate" not in plan and "Window" not in plan


def test_scores_of_nested_branches_equal_the_matrix(spark, monkeypatch):
    monkeypatch.setattr(mixture, "TAKEN", 7)
    monkeypatch.setattr(mixture, "SCORED", 20)
    rows, mix = mixed_branches(spark)
    got = mixture.with_scores(sequences.nested(rows), mix)
    assert dealt_once(got)
    got = {(r.post_cell, r.branch_id, e.syn_id, f.syn_id): s for r in got.collect() for e, row in zip(r.seq, r.scores, strict=True) for f, s in zip(r.seq, row, strict=True)}
    syn = {(r.post_cell, r.branch_id, r.seq_pos): r.syn_id for r in rows.collect()}
    want = {(r.post_cell, r.branch_id, syn[r.post_cell, r.branch_id, r.i], syn[r.post_cell, r.branch_id, r.j]): r.score for r in mixture.score_matrix(rows, mix).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want) and any(want.values())


def test_branches_of_all_lengths_draw_together(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(shuffles, "ENTRIES", 40)
    rng = np.random.default_rng(4)
    sizes = [1, 5, 3, 0, 5, 2, 3, 3, 7]
    scores = [np.where(rng.random((n, n)) < 0.3, 0.0, rng.random((n, n))) for n in sizes]
    u = [rng.random((3, n)) for n in sizes]
    arrays = [pa.array([m.tolist() for m in x], pa.list_(pa.list_(pa.float64()))) for x in (scores, u)]
    want = [shuffles.draw_without_replacement(m, d).tolist() if m.size else [[]] * 3 for m, d in zip(scores, u, strict=True)]
    assert shuffles._permuted(*arrays, False).to_pylist() == want
    assert shuffles._permuted(*arrays, True).to_pylist() == [np.argsort(np.array(p), axis=1).tolist() for p in want]
    assert all(sorted(p) == list(range(n)) for n, b in zip(sizes, want, strict=True) for p in b)


def test_segment_rows_leave_out_what_is_unknown(spark, monkeypatch):
    monkeypatch.setattr(mixture, "TAKEN", 7)
    rows, mix = mixed_branches(spark)
    rows = rows.withColumn("x", F.when(F.col("syn_id") % 11 != 0, F.col("x")))
    out = mixture.segment_probs(rows, mix)
    assert dealt_once(out) and dict(out.dtypes)["seg"] == "int"
    want, branches = set(), {}
    for r in rows.collect():
        branches.setdefault((r.post_cell, r.branch_id), []).append(r)
    for k, b in branches.items():
        b.sort(key=lambda r: r.seq_pos)
        if len(b) >= 3:
            want |= {(*k, e.seq_pos, o.seq_pos) for e in b if e.pre_cell for o, p in zip(b, b[1:], strict=False) if o.x is not None and p.x is not None}
    got = {(r.post_cell, r.branch_id, r.i, r.seg): r.prob for r in out.collect()}
    assert set(got) == want
    total = {}
    for k, p in got.items():
        total.setdefault(k[:3], []).append(p)
    assert all(sum(p) <= 1 + 1e-9 for p in total.values()) and any(math.isclose(sum(p), 1) for p in total.values())


def test_segments_go_with_whole_branches(spark):
    rows, mix = mixed_branches(spark)
    assert dealt_once(mixture.with_segments(sequences.nested(rows), mix))


def test_places_of_many_cells_are_scored_cell_by_cell():
    """The same sums, in less than a third of the time that fetching components for each place takes."""
    import time

    rng = np.random.default_rng(1)
    c = {k: rng.random(600) for k in mixture._NUMBERS}
    first, n = np.arange(0, 600, 6), np.full(100, 6)
    n[3] = 0
    cuts = np.append(0, np.cumsum(rng.integers(0, 4000, 100)))
    at, row = rng.random((cuts[-1], 3)), np.repeat(np.arange(100), np.diff(cuts))
    took = []
    for f in (lambda: mixture._summed(at, row, first, n, c), lambda: mixture._summed_runs(at, cuts, first, n, c)):
        start = time.process_time()
        out = f()
        took.append((time.process_time() - start, out))
    assert np.allclose(took[0][1], took[1][1], rtol=1e-13, atol=0) and took[1][0] < took[0][0] / 3
