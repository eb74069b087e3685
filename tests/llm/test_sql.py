"""The queries of this package that SQL can express, against their SQL."""

from __future__ import annotations

import pytest

from tests.comparison import normalized, sql_rows
from waymark.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    found = QUERIES[name](spark, SMALL)
    names, _, rows = sql_rows(SMALL, ORACLES[name])
    assert sorted(found.columns) == sorted(names)
    assert normalized(found.columns, found.collect()) == normalized(names, rows)
