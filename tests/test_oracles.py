"""Every registered query of the reference's operators against its SQL, at the smallest scale."""

import pytest
from conftest import SMALL

from loomspan.plans import registry

import oracle


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_equals_sql(spark, con, name):
    oracle.check(spark, con, registry.queries()[name], registry.oracles()[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracles())))
def test_query_without_sql_has_rows(spark, name):
    assert not registry.queries()[name](spark, SMALL).isEmpty()


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
