"""Every query against its SQL twin on the smallest tables."""

import duckdb
import pytest
from conftest import SF_DIR

from __spark_entry__ import entry, oracle_sql, queries
from memlake.plans.catalog import QUERIES
from check import TABLES, normal, same


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for table in TABLES:
        made.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return made


def test_entry(spark):
    assert entry(spark).count() == 10


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ours = queries()[name](spark, SF_DIR).toPandas()
    assert name in oracle_sql(), "every query of the library has its twin"
    theirs = con.execute(oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert same(normal(ours), normal(theirs))


def test_oracles_have_queries():
    assert set(oracle_sql()) <= set(queries())
