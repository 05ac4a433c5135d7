import pytest

from quillon.plans import catalog
from tests.oracle import connect, duck_rows, spark_rows

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, con, name):
    assert spark_rows(catalog.queries()[name](spark, small)) == duck_rows(con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_query_without_sql_gives_rows(spark, small, name):
    assert catalog.queries()[name](spark, small).limit(1).count() == 1
