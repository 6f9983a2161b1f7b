"""Rows delivered to a target in chunks: what was accepted is logged, a repeated run sends the rest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.delta import row_hash
from ..operators.fill import on_a_line
from .tables import Commits, fresh, written

#: Order of a delivery: what is withdrawn stops being found first, then rows go over older ones, then new ones.
PHASES = {"withdrawn": 0, "changed": 1, "new": 2}
#: Accepted folders in a state; beyond, they are rewritten as one.
FOLDERS = 32


class Delivery:
    """The accepted state of a target: digest by key, rows by day, one numbered state at a time.

    A chunk counts as accepted when its state is committed, and commits appear by a rename.  A run
    that dies between sending and committing sends that one chunk again, so ``send`` should
    write by key, which makes a repetition harmless; no other chunk is sent twice and none is lost.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, kind: str):
        """``kind``: the key's SQL type."""
        self._spark, self._key, self._commits = spark, key, Commits(spark, path)
        self._schema = f"{key} {kind}, digest string, number long"

    def accepted(self) -> DataFrame:
        """(key, digest) that the target has, by the last word on each key."""
        _, state = self._commits.last()
        folders = state.get("folders", [])
        log = self._spark.read.schema(self._schema).parquet(*folders) if folders else self._spark.createDataFrame([], self._schema)
        last = log.groupBy(self._key).agg(F.max_by("digest", "number").alias("digest"))
        return last.filter("digest is not null")  # null: withdrawn

    def spent(self, day: str) -> int:
        return self._commits.last()[1].get("spent", {}).get(day, 0)

    def pending(self, rows: DataFrame, most: int) -> DataFrame:
        """``rows`` to be sent with ``change``, ``digest`` and ``chunk`` (``most`` rows each but the
        last): keys that the target has and ``rows`` has not are withdrawn (other columns null)."""
        rest = [c for c in rows.columns if c != self._key]
        now = rows.select(self._key, F.struct(*rest).alias("_row"), row_hash(*rest).alias("_is"))
        both = now.join(self.accepted().withColumnRenamed("digest", "_was"), self._key, "full_outer")
        change = F.when(F.col("_is").isNull(), "withdrawn").when(F.col("_was").isNull(), "new").when(F.col("_was") != F.col("_is"), "changed")
        todo = both.withColumn("change", change).filter("change is not null")
        phase = F.create_map(*[F.lit(x) for p in PHASES.items() for x in p])[F.col("change")]
        todo = todo.select(self._key, *[F.col(f"_row.{c}").alias(c) for c in rest], "change", F.col("_is").alias("digest"), phase.alias("_phase"), F.lit(1).alias("_one"))
        line = on_a_line(todo, ["_phase", self._key], "_one")
        return line.select(self._key, *rest, "change", "digest", F.floor(F.col("_pos") / most).cast("long").alias("chunk"))

    def deliver(self, rows: DataFrame, send: Callable[[DataFrame, int], None], most: int, day: str, budget: int | None = None) -> int:
        """Send what the target lacks, a chunk at a time; how many chunks the day's budget of rows left over.

        ``rows`` has one row a key, which is not null.  The plan is written once, in ranges of its
        order, so a task writes to few chunks and a large chunk is many files; each chunk is read
        from its own folder.  The loop holds numbers of chunks and their counts only.
        """
        path = fresh(self._spark, "plan")
        plan = self.pending(rows, most)
        plan.write.partitionBy("chunk").parquet(path)
        plan = self._spark.read.schema(plan.schema).parquet(path)
        sizes = sorted((r.chunk, r["count"]) for r in plan.groupBy("chunk").count().collect())  # a row a chunk
        for done, (chunk, n) in enumerate(sizes):
            number, state = self._commits.last()
            spent = state.get("spent", {})
            if budget is not None and spent.get(day, 0) + n > budget:
                return len(sizes) - done
            part = plan.filter(F.col("chunk") == chunk)
            send(part.drop("digest", "chunk"), chunk)
            log = fresh(self._spark, "accepted")
            part.select(self._key, "digest", F.lit(number + 1).cast("long").alias("number")).write.parquet(log)
            self._commits.commit(number + 1, {"folders": [*state.get("folders", []), log], "spent": spent | {day: spent.get(day, 0) + n}})
            if len(state.get("folders", [])) + 1 >= FOLDERS:
                self.compact()
        return 0

    def compact(self) -> None:
        """The accepted state as one folder; readers of the states before keep theirs."""
        number, state = self._commits.last()
        path = fresh(self._spark, "accepted")
        written(self.accepted().withColumn("number", F.lit(number + 1).cast("long")).select(self._key, "digest", "number"), path)
        self._commits.commit(number + 1, state | {"folders": [path]})

    def forget(self) -> None:
        """Nothing counts as accepted any more: the next run sends all rows again.  Days spent stay."""
        number, state = self._commits.last()
        self._commits.commit(number + 1, state | {"folders": []})
