import random

import numpy as np
import pytest

from arborseq.operators import distributions

SCHEMA = "shuffle string, trial int, v double"


@pytest.mark.parametrize("trials", [None, 10])
def test_all_tables_against_plain_numbers(spark, trials):
    """One model holds most rows, values tie, some lie outside, one trial has none."""
    rng = random.Random(2)
    rows = [("original", 0, float(rng.randrange(20))) for _ in range(31)] + [("type", rng.randrange(2), rng.choice([7.0, rng.uniform(-5, 40)])) for _ in range(700)]
    rows += [("random", t, float(rng.randrange(60))) for t in range(4) for _ in range(10)] + [("random", 4, None), ("random", 4, float("nan")), ("axon", 0, 3.0)]
    edges = [0.0, 5.0, 5.5, 20.0, 30.0]
    got = distributions.distribution(spark.createDataFrame(rows, SCHEMA), "v", edges, trials)
    known = [(s, t, v) for s, t, v in rows if v is not None and v == v]
    models = sorted({s for s, _, _ in known})
    of = {m: np.array([v for s, _, v in known if s == m]) for m in models}
    n_trials = {m: 1 if m == "original" else trials or len({t for s, t, _ in known if s == m}) for m in models}
    bars = {(r.shuffle, r.bin): (r.low, r.high, r.n, r.per_trial) for r in got.pdf.collect()}
    want = {(m, i): (edges[i], edges[i + 1], int(n), n / n_trials[m]) for m in models for i, n in enumerate(np.histogram(of[m], edges)[0])}
    assert bars == want
    lines = {}
    for r in got.cdf.collect():
        lines.setdefault((r.shuffle, r.trial), []).append((r.value, r.n, round(r.percent, 9)))
    groups = {(s, t) for s, t, _ in known if s != "original"} | {(m, None) for m in models}
    for s, t in groups:
        v = np.array([x for a, b, x in known if a == s and (t is None or b == t)])
        assert sorted(lines.pop((s, t))) == [(float(x), int((v == x).sum()), round(100 * float((v <= x).mean()), 9)) for x in np.unique(v)]
    assert not lines
    for r in got.stats.collect():
        v = of[r.shuffle]
        assert r.n == len(v) and np.allclose([r.mean, r.median, r.std], [v.mean(), np.median(v), v.std()])
    assert got.stats.count() == len(models)


def test_without_values(spark):
    got = distributions.distribution(spark.createDataFrame([("random", 0, None)], SCHEMA), "v", [0, 1])
    assert [t.count() for t in got] == [0, 0, 0]


def test_counts_beside_the_real_one(spark):
    counts = [("original", 0, 9), *[("random", i, n) for i, n in enumerate([1, 2, 2, 5, 6])], ("type", 0, 4), ("type", 1, 4)]
    rows = distributions.count_histogram(spark.createDataFrame(counts, "shuffle string, trial int, n long"), 5, "random").orderBy("shuffle", "bin").collect()
    v = np.array([1, 2, 2, 5, 6])
    for model, values in (("random", v), ("type", np.array([4, 4]))):
        n, ends = np.histogram(values, 5)
        mine = [r for r in rows if r.shuffle == model]
        assert [r.n for r in mine] == n.tolist() and np.allclose([r.low for r in mine] + [mine[-1].high], ends)
        assert np.allclose([r.z_low for r in mine], (ends[:-1] - v.mean()) / v.std()) and {r.real for r in mine} == {9}
