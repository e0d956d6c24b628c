"""Every registered query against its SQL; queries without SQL must give rows."""

import pytest

import oracle
from __spark_entry__ import entry, oracle_sql, queries

SQL = oracle_sql()
SLOW = ("classification_models", "regression_models", "clustering_models", "run_", "tuned_")


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, con, name):
    assert oracle.compare(name, queries()[name](spark, sf), con, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(queries()) - set(SQL)))
def test_gives_rows(spark, sf, name):
    assert queries()[name](spark, sf).count() > 0


def test_entry_has_one_row_per_column(spark):
    assert entry(spark).count() == 11
