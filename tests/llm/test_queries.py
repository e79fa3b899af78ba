import pytest

from oracle import connection, oracle_rows, rows_of
from siltstone.llm import queries


@pytest.fixture(scope="module")
def con(testdata):
    return connection(testdata)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches(spark, testdata, con, name):
    assert rows_of(queries.QUERIES[name](spark, testdata)) == oracle_rows(con, queries.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_runs(spark, testdata, name):
    assert queries.QUERIES[name](spark, testdata).count() > 0
