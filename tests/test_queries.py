"""Registered queries against DuckDB on the smallest tables."""

import os

import pytest
from oracle import differences

from lodemill.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = registry.oracle_sql()


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    assert differences(spark, registry.queries()[name], SQL[name], SF) == []
