"""Every registered query with SQL gives that SQL's rows; all run on the smallest tables."""

import decimal
import os

import pytest

from tessella.plans.catalogue import ORACLES, QUERIES

FOLDER = os.environ.get("TESSELLA_TABLES", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def told(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return f"{v:.4f}" if isinstance(v, decimal.Decimal) else str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    rows, names = df.collect(), sorted(df.columns)
    if name not in ORACLES:
        assert rows
        return
    r = duck.execute(ORACLES[name])
    found = [c[0] for c in r.description]
    assert sorted(found) == names
    want = sorted(tuple(told(x[found.index(c)]) for c in names) for x in r.fetchall())
    assert sorted(tuple(told(x[c]) for c in names) for x in rows) == want


def test_entry_without_the_corpus_subpackage(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
