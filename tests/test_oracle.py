"""Every query outside the llm package against its SQL, on the smallest test tables."""

import importlib

import pytest

import __spark_entry__
from oracle import connection, oracle_rows, rows_of

SUITES = [s for s in __spark_entry__.SUITES if ".llm" not in s]
QUERIES, ORACLE = {}, {}
for suite in SUITES:
    QUERIES |= importlib.import_module(suite).QUERIES
    ORACLE |= importlib.import_module(suite).ORACLE


@pytest.fixture(scope="module")
def con(testdata):
    return connection(testdata)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches(spark, testdata, con, name):
    assert rows_of(QUERIES[name](spark, testdata)) == oracle_rows(con, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, testdata, name):
    assert QUERIES[name](spark, testdata).columns


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns
