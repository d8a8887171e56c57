"""Every registered ledger query equals its SQL."""

import pytest

from ledgerloom.plans import registry

from . import oracle


@pytest.fixture(scope="module")
def con():
    return oracle.tables()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    oracle.same_rows(registry.QUERIES[name](spark, oracle.DATA), con, registry.ORACLES[name])
