"""Every registered query against its SQL on the smallest data."""

import pytest

import __spark_entry__ as entry
from checks.compare import difference, duck


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, sf, con, name):
    result = difference(entry.queries()[name](spark, sf), entry.oracle_sql()[name], con)
    assert result in (None, "no rows"), result
