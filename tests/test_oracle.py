from __future__ import annotations

import compare
import pytest

from sluice.plans import suite


@pytest.fixture(scope="module")
def con(sf):  # noqa: ANN001, ANN201
    return compare.connect(sf)


@pytest.mark.parametrize("name", sorted(suite.QUERIES))
def test_query_equals_sql(name, spark, sf, con):  # noqa: ANN001
    assert compare.differences(suite.QUERIES[name](spark, sf), con, suite.ORACLE_SQL[name]) == ""
