"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import os

import pytest

from docframe.plans import catalog

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return con


def plain(v):
    return repr(float(v)) if type(v).__name__ in ("float", "Decimal") else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    frame = catalog.QUERIES[name](spark, DIR)
    rows = [[plain(v) for v in r] for r in frame.collect()]
    if name not in catalog.ORACLES:
        assert rows
        return
    found = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(frame.columns)
    at = [names.index(c) for c in frame.columns]
    assert sorted(rows) == sorted([plain(r[i]) for i in at] for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
