"""Every query of the catalog against its DuckDB oracle."""

import pytest

from foldmill import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_oracle(spark, duck, same_rows, name):
    found = catalog.QUERIES[name](spark, SMALL).toPandas()
    same_rows(found, duck.sql(catalog.ORACLES[name]).df())


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["seq", "op", "key", "got", "reply"] and out.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
