import __spark_entry__ as entry


def test_contract(spark):
    known, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(known) and len(known) > 50
    assert entry.entry(spark).count() > 0
