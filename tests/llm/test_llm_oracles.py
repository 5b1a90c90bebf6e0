import pytest
from oracle import compare, connection

from forumlens.llm import queries


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    compare(spark, con, queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_without_sql_covers_the_table(spark, name):
    from oracle import SF

    assert queries.QUERIES[name](spark, SF).count() >= spark.read.parquet(f"{SF}/documents.parquet").count()
