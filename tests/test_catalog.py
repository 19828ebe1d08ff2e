"""Every registered query against its SQL, and the rest for rows."""

import pytest
from oracle import difference

import __spark_entry__ as contract

DATA = "/root/testdata/sf0.001"
CHECKED = contract.oracle_sql()


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, name):
    query = contract.queries()[name]
    if name in CHECKED:
        assert difference(spark, DATA, query, CHECKED[name]) is None
    else:
        assert query(spark, DATA).count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() > 0
