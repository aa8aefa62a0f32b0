import pytest

from annalist.plans import catalog

from .oracle import connect, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    same(spark, con, SF, catalog.QUERIES[name], catalog.ORACLE_SQL[name])
