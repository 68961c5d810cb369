"""Every query of the catalogue with SQL, against DuckDB over the smallest tables."""

import glob
import os

import duckdb
import pytest

from skein.plans import assembly, catalog, files, runs, scores, streams, survey, tokens  # noqa: F401

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    return repr(round(float(v), 5) + 0.0) if v is not None and (isinstance(v, float) or type(v).__name__ == "Decimal") else repr(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, D)
    rows, names = df.collect(), sorted(df.columns)
    rel = con.sql(catalog.SQL[name])
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    assert sorted(tuple(plain(r[c]) for c in names) for r in rows) == sorted(tuple(plain(r[k]) for k in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, D).count() > 0
