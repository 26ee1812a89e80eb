"""Every engine query with SQL gives the SQL's rows."""

import math

import pytest

from arborseq.plans.queries import ORACLE_SQL, QUERIES


def cell(v):
    if v is None or isinstance(v, str | bool):
        return v
    v = float(v)
    return None if math.isnan(v) else round(v, 6) + 0.0


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(name, spark, data, duck):
    df = QUERIES[name](spark, data)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_other_queries_run(name, spark, data):
    assert QUERIES[name](spark, data).count() > 0
