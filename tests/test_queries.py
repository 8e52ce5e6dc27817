"""Every query with SQL against DuckDB on the same tables."""

import glob
import os

import duckdb
import pytest

from licet.queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(row):
    return tuple(round(float(x), 9) if isinstance(x, float) or hasattr(x, "as_tuple") else x for x in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((plain(r) for r in df.select(*cols).collect()), key=repr)
    if name not in ORACLE_SQL:
        assert got
        return
    rel = db.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    want = sorted((plain(r) for r in rel.select(*(duckdb.ColumnExpression(c) for c in cols)).fetchall()), key=repr)
    assert got == want
