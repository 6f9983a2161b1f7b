"""Exact greedy block fill, spread over tasks.

The plain loop takes items in order and begins a new block when the next item no longer fits.
Here every item first learns where the next block would begin if one began with it: prefix sums,
taken in ranges and then over the ranges, put all items on one line, and a window over a stretch
of the line finds the last item that begins within ``most`` of it.  Pointer doubling then follows
those links from the first item: a table for each power of two, and as many rounds as the
logarithm of the number of blocks.  No task sees more than a stretch of the line.

An item larger than ``most`` has a block of its own; null sizes count as 0; an empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import written

#: Block sizes that a stretch of the line is long.
STRETCH = 64
#: Items in a bucket of positions.
RUN = 4096


def on_a_line(items: DataFrame, order: list[str], size: str, parts: int | None = None) -> DataFrame:
    """``items`` with _size, _pos (from 0) and _before (the sum of sizes before) by ``order``: ranges
    of the order are numbered in their own tasks, and their sums put them on one line."""
    spark = items.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = items.withColumn("_size", F.coalesce(F.col(size).cast("long"), F.lit(0)))
    rows = written(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    sums = rows.groupBy("_range").agg(F.count("*").alias("_n"), F.sum("_size").alias("_s"))  # a row a range
    over = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_range", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(over), F.lit(0)).alias("_s0"))
    within = Window.partitionBy("_range").orderBy(*order)
    run = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"_pos": F.row_number().over(within) - 1, "_before": F.sum("_size").over(run) - F.col("_size")})
    return rows.join(F.broadcast(offsets), "_range").select(*items.columns, "_size", (F.col("_pos") + F.col("_n0")).alias("_pos"), (F.col("_before") + F.col("_s0")).alias("_before"))


def _links(line: DataFrame, most: int) -> DataFrame:
    """(pos, next): where the next block begins if one begins at pos; null at the end."""
    wide = most * STRETCH
    lane = F.floor(F.col("_before") / wide)
    rows = line.select(F.col("_pos").alias("pos"), F.col("_before").alias("before"), (F.col("_before") + F.col("_size")).alias("after"), lane.alias("own"))
    # the beginning of a stretch is seen from the one before as well
    seen = rows.withColumn("lane", F.explode(F.when(F.col("before") - F.col("own") * wide <= most, F.array(F.col("own"), F.col("own") - 1)).otherwise(F.array("own"))))
    reach = Window.partitionBy("lane").orderBy("before").rangeBetween(0, most)
    linked = seen.select("pos", "before", "own", "lane", F.max("pos").over(reach).alias("last"), F.max("after").over(reach).alias("end")).filter("own = lane")
    following = F.when(F.col("end") <= F.col("before") + most, F.lit(None)).when(F.col("last") == F.col("pos"), F.col("pos") + 1).otherwise(F.col("last"))
    return linked.select("pos", following.cast("long").alias("next"))


def block_starts(line: DataFrame, most: int) -> DataFrame:
    """The positions at which blocks begin."""
    jumps = [written(_links(line, most))]
    while jumps[-1].filter("pos = 0 and next is not null").count():
        a = jumps[-1]
        b = a.select(F.col("pos").alias("next"), F.col("next").alias("_n"))
        jumps.append(written(a.join(b, "next", "left").select("pos", F.col("_n").alias("next"))))
    reached = line.filter("_pos = 0").select(F.col("_pos").alias("pos"))
    for jump in reversed(jumps):
        there = jump.join(reached, "pos").filter("next is not null").select(F.col("next").alias("pos"))
        reached = written(reached.union(there.join(line.select(F.col("_pos").alias("pos")), "pos", "left_semi")))
    return reached


def filled(items: DataFrame, order: list[str], size: str, most: int) -> DataFrame:
    """``items`` with ``block``, the position (from 0) of the first item of their block, and their
    own ``position``.  ``order`` should tell all rows apart."""
    line = written(on_a_line(items, order, size))
    starts = block_starts(line, most)
    run = F.floor(F.col("_pos") / RUN)
    marked = line.join(starts.select(F.col("pos").alias("_pos"), F.col("pos").alias("_start")), "_pos", "left").withColumn("_run", run)
    last = marked.groupBy("_run").agg(F.max("_start").alias("_last"))  # a row for each RUN items
    carry = last.select("_run", F.max("_last").over(Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    within = Window.partitionBy("_run").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    block = F.coalesce(F.max("_start").over(within), F.col("_carry"))
    return marked.join(carry, "_run").select(*items.columns, F.col("_pos").alias("position"), block.alias("block"))
