"""Every registered query agrees with its SQL, or gives filled rows where SQL has none."""

import pytest

import __spark_entry__ as entry
from entwine.plans import catalogue
from tests.sqlcheck import agrees, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n in catalogue.ORACLES])
def test_against_sql(spark, sf, con, name):
    assert not agrees(catalogue.QUERIES[name](spark, sf), con, catalogue.ORACLES[name])


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in catalogue.ORACLES])
def test_runs(spark, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    rows = df.limit(2000).collect()
    assert rows and len(set(df.columns)) == len(df.columns)
    # no column is empty throughout
    assert all(any(r[c] is not None for r in rows) for c in df.columns)


def test_entry(spark):
    assert entry.entry(spark).columns and set(entry.oracle_sql()) <= set(entry.queries())
