"""Series over time and order: spines, islands, running totals, versions, budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cumulative(df: DataFrame, key: str, day: Column, last: int) -> DataFrame:
    """key, day, n, total: events of each day and so far, for the ``last`` days that have any."""
    daily = df.groupBy(F.col(key), day.alias("day")).agg(F.count("*").alias("n"))
    run = Window.partitionBy(key).orderBy("day")
    out = daily.withColumn("total", F.sum("n").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("day")))).filter(F.col("_r") <= last).drop("_r")


def daily_spine(df: DataFrame, key: str, day: Column, ok: Column, first: str, last: str) -> DataFrame:
    """key, day, checks, ok, uptime, state: every day of a range, those without a check too."""
    checks = df.groupBy(F.col(key), day.alias("day")).agg(F.count("*").alias("checks"), F.sum(ok.cast("long")).alias("ok"))
    spine = df.select(key).distinct().withColumn("day", F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))))
    out = spine.join(checks, [key, "day"], "left").select(key, "day", F.coalesce("checks", F.lit(0)).alias("checks"), F.coalesce("ok", F.lit(0)).alias("ok"))
    up = F.round(F.try_divide(F.col("ok"), F.col("checks")), 4)
    return out.withColumn("uptime", up).withColumn("state", F.when(F.col("checks") == 0, "none").when(up >= 0.99, "up").when(up >= 0.5, "partial").otherwise("down"))


def islands(df: DataFrame, key: str, order: list[str], bad: Column, start: str) -> DataFrame:
    """key, first, last, n: maximal runs of consecutive bad rows of each key."""
    run = Window.partitionBy(key).orderBy(*order)
    marked = df.withColumn("_bad", bad).withColumn("_g", F.sum((~F.col("_bad")).cast("int")).over(run.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.filter("_bad").groupBy(key, "_g").agg(F.min(start).alias("first"), F.max(start).alias("last"), F.count("*").alias("n")).drop("_g")


def version_diff(df: DataFrame, key: str, version: str, fields: list[str]) -> DataFrame:
    """key, version, changed: names of the fields that differ from the version before."""
    by = Window.partitionBy(key).orderBy(version)
    before = F.lag(F.struct(*fields)).over(by)
    named = F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_p.{f}")), F.lit(f)) for f in fields])
    return df.withColumn("_p", before).filter("_p is not null").select(key, version, F.array_join(F.array_compact(named), ",").alias("changed"))


def budget_cut(df: DataFrame, by: list[str], order: list, cost: str, room: int) -> DataFrame:
    """Rows with ``total`` and ``sent``: a row goes while the running cost stays within the
    budget; after the first that does not, everything waits."""
    run = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = df.withColumn("total", F.sum(cost).over(run))
    return total.withColumn("sent", F.col("total") <= room)


def new_keys(df: DataFrame, used: DataFrame, key: str, day: str) -> DataFrame:
    """key, id: day * 100000 + n for keys not in ``used`` (key, id), going on from the day's last."""
    top = used.groupBy(F.floor(F.col("id") / 100000).alias("_day")).agg(F.max(F.col("id") % 100000).alias("_top"))
    fresh = df.join(used, key, "left_anti").join(top, F.col(day) == F.col("_day"), "left")
    n = F.row_number().over(Window.partitionBy(day).orderBy(key)) + F.coalesce("_top", F.lit(-1))
    return fresh.select(key, (F.col(day) * 100000 + n).cast("long").alias("id"))


def kept_events(df: DataFrame, key: list[str], at: str, order: str, gap: int) -> DataFrame:
    """Events that no *kept* event of the same key precedes by less than ``gap`` seconds.

    A key's rows come sorted and are folded as they stream by, with the time last kept as the
    only state: chains keep every event that is far enough from the last one kept, which a
    comparison with the neighbour misses.
    """
    times = df.select(*key, F.col(order), F.unix_timestamp(at).alias("_t")).repartition(*key).sortWithinPartitions(*key, "_t", order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for batch in batches:
            keep = []
            for *k, t in zip(*(batch.column(c).to_pylist() for c in (*range(len(key)), len(key) + 1)), strict=True):
                if k != now:
                    now, last = k, None
                keep.append(last is None or t - last >= gap)
                if keep[-1]:
                    last = t
            yield batch.select([*key, order]).filter(pa.array(keep, pa.bool_()))

    return times.mapInArrow(run, times.select(*key, order).schema)


def sessions(df: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """key, start, end, n: groups of events with less than ``gap`` between neighbours."""
    return df.groupBy(key, F.session_window(F.col(at).cast("timestamp"), gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
