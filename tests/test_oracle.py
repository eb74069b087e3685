"""Every registered query against its SQL equivalent."""

import os

import pytest

import __spark_entry__ as contract
from tests.comparison import differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# The text queries have tests of their own, where they are.
QUERIES = {n: q for n, q in contract.queries().items() if n not in contract.TEXT_QUERIES}
SQL = {n: q for n, q in contract.oracle_sql().items() if n not in contract.TEXT_ORACLES}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    result = QUERIES[name](spark, SF_DIR)
    if name in SQL:
        assert differences(result, SF_DIR, SQL[name]) is None
    else:
        assert result.count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_is_the_flagship(spark):
    rows = contract.entry(spark)
    assert rows.columns == ["namespace", "goal", "event_name", "bayes"]
    assert rows.count() > 0
