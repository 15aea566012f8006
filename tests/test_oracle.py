"""Every query with SQL gives the SQL's rows on the smallest tables; every other one runs."""

import os

import pytest

import __spark_entry__
from tonescope.plans.oracle import ORACLE
from tonescope.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


def cells(df):
    def cell(v):
        if v is None or str(v) in ("<NA>", "NaT") or v != v:
            return "null"
        return f"{float(v):.6f}" if isinstance(v, (int, float)) or getattr(getattr(v, "dtype", None), "kind", "-") in "iuf" else str(v)

    names = sorted(df.columns)
    return names, sorted(tuple(cell(v) for v in row) for row in df[names].itertuples(index=False))


@pytest.fixture(scope="module")
def sql():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, sql, name):
    assert cells(QUERIES[name](spark, FOLDER).toPandas()) == cells(sql.execute(ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    """All columns are computed, and there are rows."""
    rows = QUERIES[name](spark, FOLDER).collect()
    assert rows and all(any(r[c] is not None for r in rows) for c in rows[0].asDict())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
