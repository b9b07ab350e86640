import pytest
from compare import SF, duck, same

from loomgraph.plans import catalogue


@pytest.fixture(scope="module")
def con():
    return duck()


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_sql(spark, con, name):
    same(catalogue.QUERIES[name](spark, SF), catalogue.SQL[name], con)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
