import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from arborseq.operators import compare, pairs, sequences

SCHEMA = "post_cell long, branch_id long, seq_pos int, syn_id long, pre_cell long, cell_type string, x double, y double, z double"


def branch(spark, *sequences_, types=None):
    rows = [(n, n, i, 100 * n + i, c, (types or {}).get(c, "A"), float(i), 0.0, 0.0) for n, s in enumerate(sequences_) for i, c in enumerate(s)]
    return spark.createDataFrame(rows, SCHEMA)


def collapsed_places(spark, sequence, **kw):
    got = sequences.collapse(branch(spark, sequence), **kw).orderBy("seq_pos").collect()
    return [r.syn_id for r in got]


@pytest.mark.parametrize("sequence, places", [
    ([], []), ([1, 1, 1], [0]), ([1, 2], [0, 1]), ([1, 1, 2], [1, 2]), ([1, 2, 2], [0, 1]), ([1, 2, 2, 3], [0, 1, 3]), ([1, 2, 2, 1, 1], [0, 1, 3]), ([None, 1, -999, 1, 2], [3, 4]),
])
def test_collapse(spark, sequence, places):
    assert collapsed_places(spark, sequence) == places


def test_types_are_filtered_after_collapsing(spark):
    rows = branch(spark, [1, 2, 1], types={2: "X"})
    assert [r.syn_id for r in sequences.collapse(rows, ["A"]).orderBy("seq_pos").collect()] == [0, 2]
    assert [r.syn_id for r in sequences.collapse(rows, ["A"], recollapse=True).orderBy("seq_pos").collect()] == [0]
    missing = branch(spark, [1, 2]).withColumn("cell_type", sequences.F.lit(None).cast("string"))
    assert sequences.of_types(missing, ["A"]).count() == 0
    assert sequences.of_types(missing, ["A"], include_unknown=True).count() == 2


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 3), min_size=1, max_size=9))
def test_collapse_is_idempotent(spark, sequence):
    once = sequences.collapse(branch(spark, sequence)).select(*SCHEMA.replace("long", "").replace("int", "").replace("string", "").replace("double", "").replace(" ", "").split(","))
    assert [r.syn_id for r in sequences.collapse(once).orderBy("seq_pos").collect()] == [r.syn_id for r in once.orderBy("seq_pos").collect()]


def test_nested_and_flat_are_inverse(spark):
    rows = branch(spark, [3, 1, 2], [5])
    assert sorted(map(tuple, sequences.flat(sequences.nested(rows)).collect())) == sorted(map(tuple, rows.collect()))


def lcs_length(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def substring_length(a, b):
    return max((k for k in range(1, len(a) + 1) for i in range(len(a) - k + 1) for j in range(len(b) - k + 1) if a[i : i + k] == b[j : j + k]), default=0)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.lists(st.integers(0, 4), max_size=9), st.lists(st.integers(0, 4), max_size=12)), min_size=1, max_size=8))
def test_comparisons_match_plain_programs(spark, cases):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a array<long>, b array<long>")
    col = compare.F.col
    got = df.select("i", compare.lcs(spark, col("a"), col("b"), 1).alias("l"), compare.substring(spark, col("a"), col("b")).alias("s"), compare.edit_distance(spark, col("a"), col("b")).alias("d"), compare.lcs_length(spark, col("a"), col("b")).alias("n")).orderBy("i").collect()
    for r, (a, b) in zip(got, cases, strict=True):
        assert r.l.score == r.n == lcs_length(a, b) <= min(len(a), len(b))
        assert r.s.score == substring_length(a, b) <= r.l.score
        assert r.d == levenshtein(a, b)
        if r.l.score:
            assert [a[i] for i in r.l.idx_a] == [b[j] for j in r.l.idx_b]
            assert r.l.idx_a == sorted(set(r.l.idx_a)) and r.l.idx_b == sorted(set(r.l.idx_b))
        if r.s.score:
            assert a[r.s.start_a : r.s.start_a + r.s.score] == b[r.s.start_b : r.s.start_b + r.s.score]


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_similar_pairs_lose_nothing(spark, k):
    import random

    rng = random.Random(k)
    seqs = [[rng.randrange(12) for _ in range(rng.randrange(1, 9))] for _ in range(25)]
    got = {(r.cell_a, r.cell_b): r.n_shared for r in pairs.similar(branch(spark, *seqs), k).collect()}
    want = {(i, j): len(set(seqs[i]) & set(seqs[j])) for i in range(25) for j in range(i + 1, 25)}
    assert got == {p: n for p, n in want.items() if n >= k}


def test_pairs_need_a_shared_cell(spark):
    with pytest.raises(ValueError):
        pairs.similar(branch(spark, [1]), 0)


def test_from_flat_data_and_reverse(spark):
    df = spark.createDataFrame([(1, 2, [7, 8], [70, 80], [[0.0, 1.0, 2.0], [3.0, 4.0, 5.0]], ["A", "B"])], "post_cell long, branch_id long, cell_seq array<long>, syn_seq array<long>, pos_seq array<array<double>>, type_seq array<string>")
    out = sequences.reversed_branches(sequences.from_flat_data(df)).first()
    assert [(e.pre_cell, e.syn_id, e.x, e.cell_type) for e in out.seq] == [(8, 80, 3.0, "B"), (7, 70, 0.0, "A")]


def test_pairs_within_groups_need_no_list(spark):
    seqs = [[1, 2, 3], [1, 2, 4], [1, 2, 3], [2, 3, 1], [3, 2, 1]]
    groups = spark.createDataFrame([(0, 7), (1, 7), (2, 8), (3, 8), (3, 7), (3, None), (4, None)], "cell long, grp long")
    listed = spark.createDataFrame([(0, 1), (3, 0), (1, 3), (2, 3)], "cell_a long, cell_b long")
    got, want = (sorted(map(tuple, pairs.similar(branch(spark, *seqs), 2, **kw).collect())) for kw in ({"groups": groups}, {"between": listed}))
    assert got == want and len(got) == 4
