import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    out = entry.entry(spark)
    assert out.columns == ["qid", "ndcg_10", "ndcg_100", "recall", "rr"] and out.count() == 40
