"""Every registered query with SQL, on the small tables, against another engine."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tracewarden.plans import oracle, queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def same(spark_rows, cols, cursor):
    names = [x[0] for x in cursor.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    norm = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert sorted(repr(norm(r)) for r in spark_rows) == sorted(repr(norm(tuple(r[i] for i in at))) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    same([tuple(r) for r in df.select(*cols).collect()], cols, duck.execute(oracle.oracle_sql()[name]))


def test_registered():
    assert set(oracle.oracle_sql()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["skill_id", "passed", "risk_score", "risk_level", "total_findings"] and df.count() == 38
