"""One test for each finding of round 4."""

import random

import duckdb

from skein.plans import catalog, tokens  # noqa: F401


def test_unescaped_twice_is_its_sql_on_any_page(spark, tmp_path):
    # on check_l a title is cut within &quot; so that no semicolon follows; HTML decodes that, the SQL does not.
    rng = random.Random(4)
    parts = ["&quot", "&quot;", "&copy", "&copy;", "&middot", "&middot;", "&amp", "&amp;", "&am", "&", ";", "quot;", "#38;", "&eacute;", "&#233;", "&lt;", "Ã©", "É\xa0»", "Σ", "İ", "ς ", " ", "\n\x1c　", "a", "Z", "</title>"]
    pages = [None, "", "  ", '<title>A "token = &quot</title>', "&amp;amp;quot;", "&amp;ampquot;", "ΟΔΟΣ &mİddot; İ", "cafÃ© &Eacute;"]
    pages += ["".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(2000)]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(con.sql(catalog.SQL["unescaped_twice"]).fetchall())
    assert len(want) == len(pages) and sorted(map(tuple, catalog.QUERIES["unescaped_twice"](spark, str(tmp_path)).collect())) == want
