"""Incremental maintenance of tables kept as plain files: full outer joins and rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fill import on_a_line


def row_hash(*columns: str) -> Column:
    """A digest of a row's values, nulls told apart from empty text."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def delta(state: DataFrame, now: DataFrame, key: str, digest: str = "digest") -> DataFrame:
    """key, change: what must be sent to bring ``state`` (key, digest) to ``now``."""
    both = state.select(key, F.col(digest).alias("_was")).join(now.select(key, F.col(digest).alias("_is")), key, "full_outer")
    change = F.when(F.col("_was").isNull(), "new").when(F.col("_is").isNull(), "deleted").when(F.col("_was") != F.col("_is"), "changed")
    return both.select(key, change.alias("change")).filter("change is not null")


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep_filled: bool = False) -> DataFrame:
    """``old`` with the rows of ``new`` in place of theirs; with ``keep_filled`` an empty or
    null new value leaves the old one."""
    rest = [c for c in old.columns if c not in key]
    a = old.select(*key, F.struct(*rest).alias("_a"))
    b = new.select(*key, F.struct(*rest).alias("_b"))

    def pick(c: str) -> Column:
        fresh = F.col(f"_b.{c}")
        if keep_filled:
            if dict(old.dtypes)[c] == "string":
                fresh = F.nullif(fresh, F.lit(""))
            return F.coalesce(fresh, F.col(f"_a.{c}"))
        return F.when(F.col("_b").isNotNull(), fresh).otherwise(F.col(f"_a.{c}"))

    return a.join(b, key, "full_outer").select(*key, *[pick(c).alias(c) for c in rest])


def insert_or_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(key).join(old, key, "left_anti").select(*old.columns))


def replace_partition(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All rows of the parents in ``new`` give way to its rows."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").select(*old.columns).unionByName(new)


def transition(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """key, status: ``current``, ``superseded`` (its content changed) or ``withdrawn``; new keys are current."""
    both = old.select(key, F.col(content).alias("_a"), F.lit(1).alias("_old")).join(new.select(key, F.col(content).alias("_b"), F.lit(1).alias("_new")), key, "full_outer")
    return both.select(key, F.when(F.col("_new").isNull(), "withdrawn").when(F.col("_old").isNotNull() & ~F.col("_a").eqNullSafe(F.col("_b")), "superseded").otherwise("current").alias("status"))


def ring(events: Column, n: int) -> Column:
    """The last ``n`` entries of a list."""
    return F.slice(events, F.greatest(F.lit(1), F.size(events) - n + 1), F.lit(n))


def retained(df: DataFrame, at: str, now: Column, days: dict[str, int], kind: str) -> DataFrame:
    """Rows younger than their kind's age; kinds that are not named stay."""
    age = F.create_map(*[x for k, v in days.items() for x in (F.lit(k), F.lit(v))])[F.col(kind)]
    return df.filter(age.isNull() | (F.datediff(now, F.col(at)) < age))


def fill_empty(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with its null and empty values filled from ``new``; filled ones stay."""
    rest = [c for c in old.columns if c not in key]
    kinds = dict(old.dtypes)
    b = new.select(*key, F.struct(*rest).alias("_b"))
    own = {c: F.nullif(F.col(c), F.lit("")) if kinds[c] == "string" else F.col(c) for c in rest}
    return old.join(b, key, "left").select(*key, *[F.coalesce(own[c], F.col(f"_b.{c}"), F.col(c)).alias(c) for c in rest])


def deletable(rows: DataFrame, expired: Column, rule: Column, order: list[str], cost: dict[int, int], room: float) -> DataFrame:
    """Expired rows that a budget of written rows lets go: rules in order, a row costs what its
    rule says, and what one rule leaves, if only because a row of it no longer fits, goes to the next.

    Only counts by rule come to the driver.  Rules that go whole or not at all need no order; of
    the others rows are numbered in ranges of ``order``, which should tell all rows apart.
    """
    due = rows.filter(expired).withColumn("_rule", rule)
    counts = {r["_rule"]: r["count"] for r in due.filter(F.col("_rule").isin(list(cost))).groupBy("_rule").count().collect()}  # a row a rule
    takes, left = {}, room
    for k in sorted(counts):
        takes[k] = min(counts[k], int(left // cost[k]))
        left -= takes[k] * cost[k]
    out = due.filter(F.col("_rule").isin([k for k, n in takes.items() if n == counts[k]]))
    for k, n in takes.items():
        if 0 < n < counts[k]:
            line = on_a_line(due.filter(F.col("_rule") == k).withColumn("_one", F.lit(1)), order, "_one")
            out = out.unionByName(line.filter(F.col("_pos") < n).select(*out.columns))
    return out.select(*rows.columns)


def may_publish(new: Column, last: Column, least: float = 0.5) -> Column:
    """Not when there is nothing, or less than ``least`` of what was published last."""
    return (new > 0) & ((F.coalesce(last, F.lit(0)) == 0) | (new >= least * last))


def suppressed(rows: DataFrame, asked: DataFrame, digest: Column, key: str) -> DataFrame:
    """``rows`` without those whose owner asked to be forgotten, known by digest only."""
    return rows.withColumn("_d", digest).join(asked.select(F.col(key).alias("_d")).distinct(), "_d", "left_anti").drop("_d")


def provenance(old: DataFrame, new: DataFrame, key: list[str], rank: str) -> DataFrame:
    """One row for each key (entity and field): a source of higher rank writes over a lower
    one, an equal rank over an equal one, and a lower one writes nothing."""
    rest = [c for c in old.columns if c not in key]
    both = old.select(*key, *rest, F.lit(0).alias("_t")).unionByName(new.select(*key, *rest, F.lit(1).alias("_t")))
    best = both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(rank, "_t")).alias("_row"))
    return best.select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest])
