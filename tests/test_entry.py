import __spark_entry__ as E
from concilia import catalog


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0]["total_tax"] > 0
    assert df.columns == E.entry(spark).columns


def test_every_query_has_a_callable_and_oracle_keys_match(spark):
    qs, oracle = E.queries(), E.oracle_sql()
    assert set(oracle) <= set(qs)
    assert len(qs) >= 60
    # every query of the library's own operators has an oracle
    assert set(catalog.QUERIES) <= set(oracle)
