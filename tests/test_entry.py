import __spark_entry__ as entry


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["start_layer", "end_layer", "n"]
    assert out.count() == 16


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150
