"""Order-dependent choices within a group: sorted rows stream by, with counters as the only state."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def capped(df: DataFrame, seed: int, order: list[str], by: dict[str, int]) -> DataFrame:
    """Rows in a fixed random order, of each value of a column at most its cap: with one
    column this is exact and needs no sequential pass."""
    shuffled = df.withColumn("_h", F.xxhash64(*order, F.lit(seed)))
    for c, k in by.items():
        shuffled = shuffled.withColumn("_r", F.row_number().over(Window.partitionBy(c).orderBy("_h", *order))).filter(F.col("_r") <= k).drop("_r")
    return shuffled.drop("_h")


def diversified(candidates: DataFrame, group: str, score: str, limits: dict[str, int], once: tuple[str, str]) -> DataFrame:
    """Best first, a candidate is taken unless a value of a limited column is used up, or its
    first ``once`` column (a file) was taken with another of the second (a unit)."""
    ordered = candidates.repartition(group).sortWithinPartitions(group, F.desc(score), *limits)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used, owner = (), {}, {}
        for batch in batches:
            keep = []
            for g, file, unit, *values in zip(*(batch.column(c).to_pylist() for c in (group, *once, *limits)), strict=True):
                if (g,) != now:
                    now, used, owner = (g,), {}, {}
                keep.append(all(used.get((c, v), 0) < k for (c, k), v in zip(limits.items(), values, strict=True)) and owner.get(file, unit) == unit)
                if keep[-1]:
                    for c, v in zip(limits, values, strict=True):
                        used[c, v] = used.get((c, v), 0) + 1
                    owner[file] = unit
            yield batch.filter(pa.array(keep, pa.bool_()))

    return ordered.mapInArrow(pick, candidates.schema)
