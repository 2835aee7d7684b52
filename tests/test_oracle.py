"""Every query with SQL equals that SQL, row by row."""

import pytest

from tests.compare import connect, differences
from inkmark.plans.registry import all_oracles, all_queries


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_oracle_has_a_query():
    assert set(all_oracles()) <= set(all_queries())


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert differences(all_queries()[name](spark, sf_dir), duck, all_oracles()[name]) is None
