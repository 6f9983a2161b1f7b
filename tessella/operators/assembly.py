"""Whole documents from many inputs of one key: one exchange an input, bounded lists, a digest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = "_key"


def _keyed(rows: DataFrame, key: str) -> DataFrame:
    """Rows that belong to a document; a null key, however many rows have it, travels nowhere."""
    return rows.filter(F.col(key).isNotNull()).withColumn(KEY, F.col(key).cast("long"))


def one(rows: DataFrame, key: str, name: str, fields: list[Column], order: list[str]) -> DataFrame:
    """(key, name): the fields of each key's row that is last by ``order``."""
    return _keyed(rows, key).groupBy(KEY).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias(name))


def many(rows: DataFrame, key: str, name: str, fields: list[Column], order: list[str | Column], most: int) -> DataFrame:
    """(key, name): ``items``, the first ``most`` rows of each key by ``order``, and ``partial``.

    Every task keeps ``most + 1`` rows a key before the exchange, so a key with a third of all
    rows sends no more than others; ``order`` should tell rows apart.
    """
    at = Window.partitionBy(KEY).orderBy(*order)
    few = _keyed(rows, key).withColumn("_k", F.row_number().over(at)).filter(F.col("_k") <= most + 1)
    listed = few.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("_k", F.struct(*fields).alias("item")))).alias("_l"))
    items = F.transform(F.slice("_l", 1, most), lambda x: x["item"])
    return listed.select(KEY, F.struct(items.alias("items"), (F.size("_l") > most).alias("partial")).alias(name))


def folded(rows: DataFrame, key: str, name: str, aggregates: list[Column]) -> DataFrame:
    """(key, name): aggregates of each key's rows, combined before the exchange."""
    grouped = _keyed(rows, key).groupBy(KEY).agg(*aggregates)
    return grouped.select(KEY, F.struct(*[c for c in grouped.columns if c != KEY]).alias(name))


def assemble(base: DataFrame, key: str, inputs: list[DataFrame], volatile: list[str] = ()) -> DataFrame:
    """``base`` with a column an input (null where it has nothing) and ``digest``: the SHA-256 of
    the JSON of all columns but ``volatile``, names in order, nulls written.

    Inputs come from ``one``, ``many`` and ``folded``, grouped by the key they are joined on, so
    joins add no exchange of theirs.  Rows of ``base`` whose key is null stay, with no inputs.
    """
    keyed = base.withColumn(KEY, F.col(key).cast("long"))
    whole = reduce(lambda a, b: a.join(b, KEY, "left"), inputs, keyed).drop(KEY)
    told = [c for c in sorted(whole.columns) if c not in volatile]
    return whole.withColumn("digest", F.sha2(F.to_json(F.struct(*told), {"ignoreNullFields": "false"}), 256))
