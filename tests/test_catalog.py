import pytest
from compare import same, views

from vellum.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return views()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    same(spark, con, QUERIES[name], ORACLES[name])
