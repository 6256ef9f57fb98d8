import __spark_entry__ as entry


def test_flagship_runs(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 5 and all(0 < r.ap < 1 for r in rows)


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150
