"""Erasure through all tables: the closure of a deletion over the references that tables declare."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import fresh


@dataclass(frozen=True)
class Ref:
    """``columns`` of ``child`` name ``parent_columns`` of ``parent``.

    ``cascade``: a child goes with its parent.  ``orphan``: a parent that lost a child goes when
    no row of any of its ``orphan`` references is left.  ``mask``: a child stays and its columns
    become null.  A reference with a null names nothing.
    """

    child: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    rule: str = "cascade"


def _meet(left: DataFrame, columns, right: DataFrame, how: str, safe: bool = False) -> DataFrame:
    """``left`` joined by equality of ``columns`` with the columns of ``right``, in order."""
    named = right.toDF(*[f"_r{k}" for k in range(len(right.columns))])
    pairs = [(F.col(c), F.col(r)) for c, r in zip(columns, named.columns, strict=True)]
    on = [a.eqNullSafe(b) if safe else a == b for a, b in pairs]
    return left.join(named, on, how)


def closure(tables: dict[str, DataFrame], keys: dict[str, list[str]], refs: list[Ref], seeds: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The rows of each table that go when ``seeds`` (keys by table) go: key and reference columns.

    Removal only ever causes more removal, so there is one least fixed point, cycles and
    references of a table to itself included.  Each round joins what the last one found with key
    and reference columns alone and writes its finds: rounds are as many as the longest chain, a
    round reads the tables that its finds touch, and a lost executor costs a reread.  Only
    whether a round found anything comes to the driver.  Rows that share a key go together; null
    keys count as equal.  Seeds that no row has do nothing.

    Finds are kept by what found them, since a ``cascade`` and an ``orphan`` over the same columns
    answer each other: children that went with their parent need not ask for it, nor a parent that
    has no child left for its children.  A join by columns of the key finds whole keys at once.
    """
    spark = next(iter(tables.values())).sparkSession
    used = {t: dict.fromkeys(keys[t]) for t in tables}
    for r in refs:
        used[r.child] |= dict.fromkeys(r.columns)
        used[r.parent] |= dict.fromkeys(r.parent_columns)
    slim = {t: df.select(*used[t]) for t, df in tables.items()}
    paths: dict[str, list[str]] = {t: [] for t in tables}
    over = {"cascade": set(), "orphan": set()}
    for r in refs:
        over.setdefault(r.rule, set()).add((r.child, r.columns, r.parent, r.parent_columns))

    def gone(t: str) -> DataFrame:
        return spark.read.schema(slim[t].schema).parquet(*paths[t]) if paths[t] else spark.createDataFrame([], slim[t].schema)

    def left_of(t: str, rows: DataFrame) -> DataFrame:
        return _meet(rows, keys[t], gone(t).select(*keys[t]), "left_anti", safe=True) if paths[t] else rows

    def put(t: str, rows: DataFrame) -> tuple[str, DataFrame] | None:
        path = fresh(spark, f"erased-{t}")
        rows.write.parquet(path)
        kept = spark.read.schema(slim[t].schema).parquet(path)
        return None if kept.isEmpty() else (path, kept)

    def same_keys(t: str, rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
        """All rows with the keys of ``rows``, which are found by the columns ``by``."""
        return rows if by and set(by) <= set(keys[t]) else _meet(slim[t], keys[t], rows.select(*keys[t]), "left_semi", safe=True)

    def orphans(parent: str, namers: list[Ref], front: list[tuple]) -> DataFrame | None:
        """Rows of ``parent`` that the front's rows named and that nothing left names."""
        candidates = None
        for r in namers:
            twin = (r.child, r.columns, r.parent, r.parent_columns)
            # every row that the twin found names a parent that is gone, and no other has its columns
            answered = twin in over["cascade"] and set(keys[parent]) <= set(r.parent_columns) and set(r.columns) <= set(keys[r.child])
            for t, by, rows in front:
                if t == r.child and not (answered and by == ("cascade", *twin)):
                    more = _meet(slim[parent], r.parent_columns, rows.select(*r.columns), "left_semi")
                    candidates = more if candidates is None else candidates.unionByName(more)
        made = None if candidates is None else put(parent, left_of(parent, candidates).distinct())
        if made is None:
            return None
        candidates = made[1]
        for r in namers:
            near = _meet(slim[r.child].select(*dict.fromkeys((*keys[r.child], *r.columns))), r.columns, candidates.select(*r.parent_columns), "left_semi")
            candidates = _meet(candidates, r.parent_columns, left_of(r.child, near).select(*r.columns), "left_anti")
        return candidates

    def settle(found: list[tuple]) -> list[tuple]:
        new = []
        for t, by, rows in found:
            if made := put(t, left_of(t, rows).distinct()):
                paths[t].append(made[0])
                new.append((t, by, made[1]))
        return new

    front = settle([(t, None, same_keys(t, s)) for t, s in seeds.items()])
    while front:
        found = []
        for r in refs:
            twin = (r.child, r.columns, r.parent, r.parent_columns)
            if r.rule == "cascade":
                whole = None
                for t, by, rows in front:
                    if t == r.parent and not (by == ("orphan", r.parent) and twin in over["orphan"]):
                        named = rows.select(*r.parent_columns)
                        whole = named if whole is None else whole.union(named)
                if whole is not None:
                    found.append((r.child, ("cascade", *twin), same_keys(r.child, _meet(slim[r.child], r.columns, whole, "left_semi"), r.columns)))
        for parent in dict.fromkeys(r.parent for r in refs if r.rule == "orphan"):
            namers = [r for r in refs if r.rule == "orphan" and r.parent == parent]
            rows = orphans(parent, namers, front)
            if rows is not None:
                of_key = all(set(r.parent_columns) <= set(keys[parent]) for r in namers)
                # rows that only share the key of one that is orphaned may have children: what found them is not told
                found.append((parent, ("orphan", parent) if of_key else None, rows if of_key else same_keys(parent, rows)))
        front = settle(found)
    return {t: gone(t) for t in tables}


def erased(tables: dict[str, DataFrame], keys: dict[str, list[str]], refs: list[Ref], gone: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables without what is gone, and with null where a ``mask`` reference named it."""
    out = {}
    for t, df in tables.items():
        left = _meet(df, keys[t], gone[t].select(*keys[t]), "left_anti", safe=True)
        for r in refs:
            if r.rule == "mask" and r.child == t:
                named = gone[r.parent].select(*r.parent_columns).distinct().withColumn("_hit", F.lit(True))
                right = named.toDF(*[f"_r{k}" for k in range(len(r.columns))], "_hit")
                met = left.join(right, [F.col(c) == F.col(f"_r{k}") for k, c in enumerate(r.columns)], "left")
                left = met.select(*[F.when(F.col("_hit").isNull(), F.col(c)).alias(c) if c in r.columns else F.col(c) for c in df.columns])
        out[t] = left
    return out
