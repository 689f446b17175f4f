import __spark_entry__ as entry


def test_names_and_smoke(spark):
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) > 60
    assert entry.entry(spark).count() > 0
