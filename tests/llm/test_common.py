from pyspark.sql import functions as F

from tessella.llm.common import bounded_sample, commonest, shared_dir, stash


def test_sample_is_bounded_and_the_same_in_any_partitioning(spark):
    df = spark.range(5000).select(F.col("id"), F.col("id").cast("string").alias("h"))
    a = sorted(r.id for r in bounded_sample(df.repartition(7), F.col("h"), 100).collect())
    b = sorted(r.id for r in bounded_sample(df.coalesce(1), F.col("h"), 100).collect())
    assert a == b and len(a) == 100
    assert bounded_sample(df.limit(30), F.col("h"), 100).count() == 30
    assert bounded_sample(df.limit(0), F.col("h"), 100).count() == 0


def test_commonest_keeps_whole_steps(spark):
    df = spark.createDataFrame([(k, 1000 - k) for k in range(900)] + [(k, 1) for k in range(900, 2000)], "w long, n long")
    got = {r.w for r in commonest(df, "n", 950).collect()}
    assert got == set(range(900))
    assert commonest(df, "n", 5000).count() == 2000
    assert 0 < commonest(df, "n", 100).count() <= 100
    assert commonest(df.limit(0), "n", 10).count() == 0


def test_stash_writes_to_the_shared_folder(spark):
    out = stash(spark.range(3))
    assert sorted(r.id for r in out.collect()) == [0, 1, 2]
    assert all(f.startswith(shared_dir(spark).split(":", 1)[-1].replace("//", "/")) or shared_dir(spark) in f for f in (x.replace("file://", "") for x in out.inputFiles()))
