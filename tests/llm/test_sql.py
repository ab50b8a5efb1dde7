"""Registered queries of the training-data operators against their SQL."""

import pytest

pytest.importorskip("logmere.llm")
from compare import differences

from logmere.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, name):
    assert not differences(QUERIES[name](spark, sf), SQL[name], sf)
