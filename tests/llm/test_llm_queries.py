"""Registered queries of this subpackage against DuckDB on the smallest tables."""

import os

import pytest
from oracle import differences

from lodemill.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    assert differences(spark, queries.queries()[name], queries.oracle_sql()[name], SF) == []
