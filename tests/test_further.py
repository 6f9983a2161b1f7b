"""Values of scalars and order-dependent operators, and the library without the corpus subpackage."""

import random
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.operators import delta as D
from tessella.operators import greedy as G
from tessella.operators import relational as R
from tessella.plans.catalogue import ORACLES, QUERIES


def values(spark, f, given):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(given)], "k int, x string").select("k", f(F.col("x")).alias("v")).collect()
    return [r.v for r in sorted(rows)]


def test_addresses(spark):
    given = ["https://a.org/x).", "(https://a.org/(y)", "www.a.org/z,;", "a.org/q]", " https://a.org/b c ", "http://a.org/[1]"]
    assert values(spark, S.clean_url, given) == ["https://a.org/x", "https://(https://a.org/(y)", "https://www.a.org/z", "https://a.org/q", "https://a.org/bc", "http://a.org/[1]"]
    given = ["https://github.com/Lab/Tool.git", "git@github.com:Lab/Tool.git", "https://gitlab.com/g/sub/proj/-/issues/1", "https://huggingface.co/datasets/O/N/tree", "https://example.org/a/b", None, "", "https://github.com", "https://github.com/Lab"]
    got = [tuple(v) if v else None for v in values(spark, S.repository, given)]
    assert got[:4] == [("github.com/lab/tool", "github.com", "forge", "Lab", "Tool")] * 2 + [("gitlab.com/g/sub/proj", "gitlab.com", "forge", "g", "proj"), ("huggingface.co/datasets/o/n", "huggingface.co", "data", "O", "N")]
    assert got[4:8] == [None] * 4 and got[8][:2] == ("github.com/lab", "github.com")


def test_small_scalars(spark):
    assert values(spark, S.folded, ["Éa Ñ", "Zoë", None]) == ["ea n", "zoe", None]
    got = values(spark, S.issue_references, ["fixes #12 and #3", "a#4 x/#5", "", "Closed: #7."])
    assert [[tuple(r) for r in v] for v in got] == [[(12, True), (3, False)], [], [], [(7, True)]]
    rows = spark.createDataFrame([(2026, "March", 5), (2026, "13", 5), (2026, "9", None), (None, "1", 1), (26, None, 3)], "y int, m string, d int")
    assert [r[0] for r in rows.select(S.iso_date(F.col("y"), F.col("m"), F.col("d"))).collect()] == ["2026-03-05", "2026", "2026-09", None, "0026"]
    pairs = spark.createDataFrame([("permissive", "copyleft"), ("copyleft", "copyleft"), ("copyleft", "network copyleft"), ("permissive", "weak copyleft"), ("copyleft", "non-commercial"), ("unknown", "copyleft")], "a string, b string")
    assert [r[0] for r in pairs.select(S.compatible(F.col("a"), F.col("b"))).collect()] == [False, True, False, True, False, None]


def test_choices_in_order(spark):
    rows = [(p, k * 7 % 11, k * 5 % 13, k % 4, float(k * 37 % 101)) for p in range(3) for k in range(60)]
    df = spark.createDataFrame(rows, "paper int, paragraph int, unit int, file int, score double").repartition(4)
    got = sorted(tuple(r) for r in G.diversified(df, "paper", "score", {"paragraph": 2, "unit": 2}, ("file", "unit")).collect())
    want = []
    for p in range(3):
        para, unit, owner = Counter(), Counter(), {}
        for r in sorted((r for r in rows if r[0] == p), key=lambda r: (-r[4], r[1], r[2])):
            if para[r[1]] < 2 and unit[r[2]] < 2 and owner.get(r[3], r[2]) == r[2]:
                para[r[1]] += 1
                unit[r[2]] += 1
                owner[r[3]] = r[2]
                want.append(r)
    assert got == sorted(want)
    some = G.capped(df.withColumn("id", F.monotonically_increasing_id()), 7, ["id"], {"paragraph": 3})
    assert Counter(r.paragraph for r in some.collect()) == {k: min(3, n) for k, n in Counter(r[1] for r in rows).items()}


def test_upkeep(spark):
    old = spark.createDataFrame([(1, "", None), (2, "x", 5)], "k int, a string, b int")
    new = spark.createDataFrame([(1, "n", 7), (2, "n", 7), (3, "n", 7)], "k int, a string, b int")
    assert sorted(map(tuple, D.fill_empty(old, new, ["k"]).collect())) == [(1, "n", 7), (2, "x", 5)]
    rows = spark.createDataFrame([(k, k % 2) for k in range(10)], "k int, r int")
    got = D.deletable(rows, F.col("k") < 8, F.col("r"), ["k"], {0: 2, 1: 3}, 15)
    assert sorted(r.k for r in got.collect()) == [0, 1, 2, 3, 4, 6]  # 4 at 2, then 7 of room for rows at 3
    n = spark.createDataFrame([(0, 10), (5, 10), (4, 10), (3, None)], "new int, last int")
    assert [r[0] for r in n.select(D.may_publish(F.col("new"), F.col("last"))).collect()] == [False, True, False, True]


def test_similar_counts_common_keys(spark):
    """A key too common to find candidates still counts in their score."""
    rows = [(d, "a", 0) for d in range(10)] + [(d, "b", d // 2) for d in range(10)]
    df = spark.createDataFrame(rows, "doc int, kind string, term int")
    got = {(r.doc, r.other): r.score for r in R.similar(df, "doc", "kind", "term", {"a": 1.0, "b": 1.0}, 4, 5, 0.0).collect()}
    import math

    assert set(got) == {(d, d ^ 1) for d in range(10)}
    assert all(v == pytest.approx(math.log(1 + 10 / 2) + math.log(1 + 10 / 10), abs=1e-6) for v in got.values())


def test_contained_against_all_pairs(spark):
    import random

    rng = random.Random(1)
    titles = sorted({" ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6))) for _ in range(60)})
    df = spark.createDataFrame([(t, t.split()) for t in titles], "t string, k array<string>")
    want = set()
    for a in titles:
        for b in titles:
            x, y = set(a.split()), set(b.split())
            if (len(x) < len(y) or (len(x) == len(y) and a < b)) and len(x & y) >= 0.7 * len(x) - 1e-9:
                want.add((a, b))
    assert {(r.a, r.b) for r in R.contained(df, "t", "k", 0.7).collect()} == want


def test_without_the_corpus_subpackage(tmp_path):
    """A copy from which the subpackage, its tests and the pipeline are deleted still imports."""
    root = Path(__file__).resolve().parents[1]
    for name in ("tessella", "__spark_entry__.py"):
        (shutil.copytree if (root / name).is_dir() else shutil.copy)(root / name, tmp_path / name)
    shutil.rmtree(tmp_path / "tessella" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_a_phrase_is_found_without_splitting_texts(spark):
    """Before, each text that may hold the words was split and its places listed."""
    from tessella.operators import search as Q
    from tessella.plans.catalogue import QUERIES

    texts = ["Apache  License", "xapache license", "apache licenses", "the apache, -- LICENSE.", "apache\nlicense", "apache of license apache", "", None, "apachelicense", "apache apache license"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").filter(Q.stands(F.col("t"), ["apache", "license"]))
    assert {r.id for r in df.collect()} == {0, 3, 4, 9}
    plan = QUERIES["search_phrase"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "RLIKE" in plan


def test_units_are_paired_where_the_texts_are_dealt(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(3)
    some = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    WORDS = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(120)]
    texts = [(k // 2 if k < 20 else k, some(25)) for k in range(60)] + [(70, None), (71, "")]  # ten numbers name two texts each
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, some(12)) for k in range(15)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    df = QUERIES["aligned_units"](spark, str(tmp_path))
    want = {(p, u, r): s for p, u, s, r in con.execute(ORACLES["aligned_units"]).fetchall()}
    got = {(r.para, r.unit, r["rank"]): r.score for r in df.collect()}
    assert len(want) > 10 and got == pytest.approx(want)
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning(") == 1 and "Exchange hashpartitioning(para" in plan  # words of texts; no pairs
