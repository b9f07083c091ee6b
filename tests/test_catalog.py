import pytest

from blockloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, sf, duck, same_rows, name):
    same_rows(catalog.QUERIES[name](spark, sf), duck, catalog.ORACLES[name])


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
