"""Every registered query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from siltstone.plans.catalog import ORACLE_SQL, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    out = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        out.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return out


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    result = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = sorted(repr([plain(row[names.index(c)]) for c in columns]) for row in result.fetchall())
    assert sorted(repr([plain(row[c]) for c in columns]) for row in df.collect()) == expected
    assert expected


def test_registry():
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
