"""Queries over whole tables beside those that see a part of theirs."""

import duckdb

from skein.plans import catalog, scores  # noqa: F401

D = "/root/testdata/sf0.001"


def test_milestones_stay(spark):
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{D}/events.parquet'")
    got = sorted(map(tuple, catalog.QUERIES["checkpoint_retention"](spark, D).select("step", "is_milestone", "keep").collect()))
    assert got == sorted(con.sql(catalog.SQL["checkpoint_retention"]).fetchall())
    steps = [s for s, m, _ in got if m]
    assert [s for s, m, k in got if m and k] == steps[-5:] and len(got) == con.sql("select count(distinct event_id) from events").fetchall()[0][0]
    assert all(s >= steps[-1] for s, m, k in got if k and not m)


def test_all_dimensions_of_the_covariance(spark):
    got = catalog.QUERIES["mean_cov"](spark, D)
    e = spark.read.parquet(f"{D}/embeddings.parquet")
    d, labels = len(e.first().embedding), e.select("label").distinct().count()
    assert got.count() == labels * d * (d + 1) // 2 and got.select("i").distinct().count() == d
