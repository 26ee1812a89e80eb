"""The pipeline's stages against brute force on their own inputs."""

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from arborseq.llm import near_copies
from arborseq.llm.queries import ORACLE_SQL, QUERIES

from ..test_oracle import rows
from .cases import documents
from .test_dedup import ascii_lower, brute_removed, jaccard, union_find

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def test_stages():
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "exact_dedup", "simhash_near_dedup", "suffix_array_dedup", "packing"]
    assert cp.ORACLE_SQL is None


def test_exact_stage(spark, docs, data):
    out = cp.exact_dedup(spark, docs, data)
    assert out.columns == COLUMNS
    first = {}
    for r in docs.orderBy("doc_id").collect():
        first.setdefault(ascii_lower(r.text or ""), r.doc_id)
    assert sorted(r.doc_id for r in out.collect()) == sorted(first.values())


def test_near_stage(spark, docs, data):
    out = cp.simhash_near_dedup(spark, docs, data)
    assert out.columns == COLUMNS
    known = [(r.doc_id, near_copies.shingles(r.text or "")) for r in docs.orderBy("doc_id").collect()]
    roots = union_find(len(known), [(i, j) for i in range(len(known)) for j in range(i) if jaccard(known[i][1], known[j][1]) >= 0.8])
    assert sorted(r.doc_id for r in out.collect()) == sorted(known[i][0] for i, r in enumerate(roots) if i == r)


def test_rows_that_share_an_identifier(spark, data):
    """Only the row that is a copy goes; another text under its identifier stays."""
    common, clean = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(1, common), (2, common.upper()), (2, clean), (3, common + " end"), (3, "quite another text"), (None, common)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    exact = cp.exact_dedup(spark, docs, data)
    assert sorted((r.doc_id or 0, r.text) for r in exact.collect()) == sorted((d or 0, t) for d, t in rows if t != common.upper())
    near = cp.simhash_near_dedup(spark, docs, data)
    assert sorted((r.doc_id or 0, r.text) for r in near.collect()) == sorted([(0, common), (1, common), (2, clean), (3, "quite another text")])


def test_suffix_stage(spark, docs, data):
    out = {r.doc_id: r for r in cp.suffix_array_dedup(spark, docs, data).collect()}
    want = {r[0]: r for r in brute_removed([(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()], 100)}
    for d, w in want.items():
        left = w[1] - w[2]
        if d in out:
            assert left - 6 * (w[3] + 1) <= len(out[d].text.encode()) <= left and out[d].n_chars == len(out[d].text)
        else:
            assert left < 300


def test_suffix_stage_on_white_space_nulls_and_repeats(spark, data):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "\n\t \r"), (2, None), (3, ""), (4, text), (4, text), (5, "a"), (None, "b"), (6, "\u00a0"), (7, "\x0b\x0c")]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], documents(spark, extra=False).schema)
    out = sorted(((r.doc_id or 0, r.text, r.n_chars) for r in cp.suffix_array_dedup(spark, docs, data).collect()))
    assert out == [(0, "b", 1), (4, text, len(text)), (5, "a", 1), (6, "\u00a0", 1)]


def test_stages_on_odd_documents(spark, data):
    docs = documents(spark, extra=False)
    for _, stage in cp.STAGES:
        assert stage(spark, docs.where("1 = 0"), data).count() == 0
        out = stage(spark, docs, data)
        assert out.count() > 0
        if stage is not cp.packing:
            assert out.columns == COLUMNS


def test_stages_keep_columns_with_names_of_their_own_helpers(spark, data):
    names = ["_word", "_bits", "_hit", "_gone_id", "_n", "row", "hit"]
    docs = documents(spark, extra=False)
    for n in names:
        docs = docs.withColumn(n, F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{'none' if r.doc_id is None else r.doc_id}" for r in rows for n in names)


def test_run_packs_what_the_stages_keep(spark, data):
    out = cp.run(spark, data)
    tokens = {r.doc_id: r.doc_tokens for r in out.collect()}
    total = out.groupBy("doc_id").sum("length").collect()
    assert tokens and all(tokens[r.doc_id] == r[1] for r in total)
    assert out.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(name, spark, data, duck):
    df, want = QUERIES[name](spark, data), duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
