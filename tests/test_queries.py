"""Every query with SQL gives the SQL's rows."""

import pytest

from momentlens import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck, same):
    got = QUERIES[name](spark, sf).toPandas()
    if name in ORACLES:
        same(got, duck.sql(ORACLES[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20
    assert set(e.oracle_sql()) <= set(e.queries())
