"""What the operators share: reading, stashing between jobs, and connected components."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
_written: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def prepare(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver runs from another folder, and
    give each task's matrix products one thread: more would wait for each other."""
    env = spark.sparkContext.environment
    env.setdefault("OMP_NUM_THREADS", "1")
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or in tests a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessella-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, so a lost
    executor costs a reread and not the work before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _written[back] = path
    return back


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``stash`` wrote, when all that was made from them is written too."""
    for df in tables:
        if path := _written.pop(df, None):
            jvm = df.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def sweep(spark: SparkSession, *tables: DataFrame) -> None:
    """``forget`` the tables, and have the shuffle files of ended jobs deleted: Spark deletes them
    when the driver collects its garbage, which a driver with little to do may not for hours."""
    forget(*tables)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release() -> None:
    """Give free memory of this process back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` that gives free memory back when its partition is done: workers are reused, and
    what one stage's arrays leave behind would count beside the next stage's."""
    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return whole


def bounded_sample(df: DataFrame, order: Column, most: int) -> DataFrame:
    """At most ``most`` rows of ``df`` by a hash of ``order``, the same in any partitioning.

    A row count sets a first cut on the hash, so tasks pass on a few rows more than asked for
    in all, instead of ``most`` each.
    """
    n = df.count()
    if n > 2 * most:
        df = df.filter(F.pmod(F.xxhash64(order), F.lit(1 << 30)) < int((1 << 30) * min(1.0, (1.5 * most + 200) / n)))
    return df.orderBy(F.xxhash64(order), order).limit(most)


def commonest(counts: DataFrame, n: str, most: int) -> DataFrame:
    """The rows with the largest counts, as many as fit ``most`` when counts within a
    sixteenth of an octave go together: a filter, with no order over all rows."""
    step = F.floor(F.log2(F.col(n)) * 16)
    sizes = sorted(((r.step, r["count"]) for r in counts.groupBy(step.alias("step")).count().collect()), reverse=True)  # a few hundred rows
    held, least = 0, None
    for at, size in sizes:
        if held + size > most:
            break
        held, least = held + size, at
    return counts.limit(0) if least is None else counts.filter(step >= least)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over edges (u, v) with v < u, returned in that form.

    The minimum over a node's neighbours is a partial aggregation and the way back is a
    plain join, whose hot side adaptive execution may split: a node with very many
    neighbours never lands whole in one task.
    """
    if large:
        near = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = near.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.union(least.select("u", F.col("m").alias("v")))
    return out.filter("v < u").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b), as rows (node, root).

    Alternating large-star and small-star rounds; the number of rounds grows with the
    logarithm of a component's width.  Only nodes with an edge to another node appear;
    root is the least node of the component.  Null ends and loops count for nothing; no
    edges give no rows.
    """
    def said(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    at = stash(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("v < u").distinct())
    seen = said(at)
    while seen[0]:
        before, at = at, stash(_star(_star(at, True), False))
        forget(before)
        now = said(at)
        if now == seen:
            break
        seen = now
    return at.select(F.col("u").alias("node"), F.col("v").alias("root")).union(at.select("v", "v").distinct())
