import __spark_entry__ as entry


def test_registry_is_whole():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert len(queries) > 90


def test_flagship(spark):
    out = entry.entry(spark)
    assert out.count() > 0
    assert "score_rank" in out.columns
