"""Every registered query against its check SQL on the smallest tables."""

import pytest

from chartloom.plans import CHECK_SQL, QUERIES
from tests.compare import connect, difference


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    if name in CHECK_SQL:
        assert difference(spark, duck, QUERIES[name], CHECK_SQL[name], sf_dir) is None
    else:
        assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_and_registry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
