import __spark_entry__ as entry


def test_contract(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60
    assert entry.entry(spark).columns == ["shuffle", "real", "mean", "std", "z"]


def test_without_the_second_part(monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert entry.queries() and not any(n.startswith("op") for n in entry.queries())
