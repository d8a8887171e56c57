"""Every training-data query that SQL can express equals its SQL."""

import pytest

from ledgerloom.llm import queries

from .. import oracle


@pytest.fixture(scope="module")
def con():
    return oracle.tables()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    oracle.same_rows(queries.QUERIES[name](spark, oracle.DATA), con, queries.ORACLES[name])
