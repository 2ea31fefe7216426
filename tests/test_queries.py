from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from compare import normalized

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the test tables")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_sql(spark, tables, name):
    ours = entry.queries()[name](spark, SF_DIR).toPandas()
    assert len(ours) > 0
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    theirs = normalized(tables.execute(sql).df())
    ours = normalized(ours)
    assert list(ours.columns) == list(theirs.columns) and len(ours) == len(theirs)
    for column in ours.columns:
        a, b = ours[column], theirs[column]
        assert ((a == b) | (a.isna() & b.isna())).all(), column


def test_entry(spark):
    assert entry.entry(spark).count() == 1
