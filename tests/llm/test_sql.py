"""Queries of this part against their SQL."""

import pytest
from harness import compare, connect

from kerbside.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert compare(spark, connect(SF), SF, name, QUERIES[name], ORACLES[name]) is None
