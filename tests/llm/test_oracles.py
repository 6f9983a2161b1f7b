"""The queries that have SQL give its rows on the smallest tables."""

import os

import pytest

from tessella.llm import queries as Q

FOLDER = os.environ.get("TESSELLA_TABLES", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = Q.queries()[name](spark, FOLDER)
    r = con.execute(Q.oracle_sql()[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(x[c] for c in names) for x in df.collect()) == sorted(r.fetchall())
