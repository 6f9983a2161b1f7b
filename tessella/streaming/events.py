"""Event streams: idempotent emission, daily windows, incremental file passes, deadlines.

``ts`` columns of type TIMESTAMP_NTZ are cast, as watermarks want instants.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.delta import insert_or_ignore


def timed(events: DataFrame, at: str = "ts") -> DataFrame:
    return events.withColumn(at, F.col(at).cast("timestamp"))


def incremental(events: DataFrame, key: str, late: str = "3 days", at: str = "ts") -> DataFrame:
    """Each id once, however often a pass overlaps the one before by up to ``late``."""
    return timed(events, at).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def daily_checks(events: DataFrame, late: str = "1 day", at: str = "ts") -> DataFrame:
    """day, checks, ok: a row for each day once it can no longer change."""
    days = timed(events, at).withWatermark(at, late).groupBy(F.window(at, "1 day").alias("w"))
    return days.agg(F.count("*").alias("checks"), F.count_if(F.col("event_type") != "error").alias("ok")).select(F.col("w.start").alias("day"), "checks", "ok")


def kept_once(events: DataFrame, key: str, order: str, gap: int = 86400, at: str = "ts") -> DataFrame:
    """Events that no *kept* event of the same key precedes by less than ``gap`` seconds.

    The state of a key is the time of its last kept event.  Rows of a micro-batch are sorted
    per key, so a key's rows must arrive in order across batches, within the watermark.
    A state goes once ``gap`` has passed in event time.
    """
    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values([at, order])
        kept = []
        for t, o in zip(rows[at], rows[order], strict=True):
            second = int(t.timestamp())
            if last is None or second - last >= gap:
                last = second
                kept.append((k[0], o, t))
        state.update((last,))
        state.setTimeoutTimestamp(max((last + gap) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(kept, columns=[key, order, at])

    kinds = dict(events.dtypes)
    named = timed(events, at).withWatermark(at, "1 day").select(key, order, at)
    return named.groupBy(key).applyInPandasWithState(fold, f"{key} {kinds[key]}, {order} {kinds[order]}, {at} timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def into_table(path: str, key: list[str]):
    """A ``foreachBatch`` sink that adds rows whose keys the table does not hold yet.

    A batch that is sent again after a failure finds its rows there and adds nothing.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            held = spark.read.parquet(path).select(*key)
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            batch.dropDuplicates(key).write.mode("append").parquet(path)
            return
        batch.dropDuplicates(key).join(held, key, "left_anti").write.mode("append").parquet(path)

    return write


def deadlines(jobs: DataFrame, now: str, key: str = "job", due: str = "due") -> DataFrame:
    """Jobs whose first deadline has passed, in order of it; later deadlines of a job do not count."""
    first = jobs.groupBy(key).agg(F.min(due).alias(due))
    return first.filter(F.col(due) <= F.lit(now).cast("timestamp")).orderBy(due, key)


__all__ = ["daily_checks", "deadlines", "incremental", "insert_or_ignore", "into_table", "kept_once", "timed"]
