"""Readers and writers of catalogue files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import shard


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """RFC 4180 text with a header: quoted line ends, doubled quotes, and a column of rows that do not fit."""
    return spark.read.schema(schema + ", _bad string").csv(path, header=True, sep=sep, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; damaged lines are left out."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def read_whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text: each file of a folder as one row."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_capped(files: DataFrame, by: str, path: str, size: str, each: int, count: int, total: int) -> DataFrame:
    """The files of each repository, by path, that fit the caps on one file, their number and their sum."""
    run = Window.partitionBy(by).orderBy(path).rowsBetween(Window.unboundedPreceding, 0)
    small = files.filter(F.col(size) <= each)
    return small.withColumn("_n", F.count("*").over(run)).withColumn("_s", F.sum(size).over(run)).filter((F.col("_n") <= count) & (F.col("_s") <= total)).drop("_n", "_s")


def notebook_code(raw: str = "raw"):
    """The code cells of a notebook, joined by blank lines."""
    cells = F.from_json(F.col(raw), "cells array<struct<cell_type:string,source:array<string>>>")["cells"]
    code = F.filter(cells, lambda c: c["cell_type"] == "code")
    return F.array_join(F.transform(code, lambda c: F.array_join(c["source"], "")), "\n\n")


def guarded(df: DataFrame) -> DataFrame:
    """Text that a spreadsheet would take for a formula gets an apostrophe before it."""
    text = {f.name for f in df.schema if f.dataType.simpleString() == "string"}
    return df.select(*[F.when(F.col(c).rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c)).alias(c) if c in text else F.col(c) for c in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    guarded(df).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def write_sharded(df: DataFrame, key: str, path: str, n: int = 64) -> None:
    """Rows by the shard of their key; a lookup by key reads one folder."""
    dealt = df.withColumn("lot", shard(F.col(key).cast("string"), n))
    dealt.repartition("lot").sortWithinPartitions("lot", key).write.mode("overwrite").partitionBy("lot").parquet(path)


def lookup(spark: SparkSession, path: str, key: str, value: str, n: int = 64) -> DataFrame:
    """The rows of one key: partition pruning reads its shard only."""
    lot = shard(F.lit(value), n)
    return spark.read.parquet(path).filter((F.col("lot") == lot) & (F.col(key).cast("string") == value))


def content_blocks(files: DataFrame, known: DataFrame, text: str, most: int) -> DataFrame:
    """digest, size, block: new distinct contents, dealt to blocks of about ``most`` bytes.

    Blocks follow the digest's first byte and a running sum within it, so 256 tasks at least
    share the work and no order over all contents is needed.
    """
    new = files.select(F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("size")).dropDuplicates(["digest"]).join(known, "digest", "left_anti")
    lane = F.substring("digest", 1, 2)
    run = Window.partitionBy(lane).orderBy("size", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return new.withColumn("block", F.concat(lane, F.lit("-"), F.floor(F.coalesce(F.sum("size").over(run), F.lit(0)) / most).cast("string")))


def manifests(files: DataFrame, by: str, path: str, digest: str) -> DataFrame:
    """One JSON document per repository: its files by path."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(path).alias("path"), F.col(digest).alias("digest"))))
    return files.groupBy(by).agg(F.to_json(listed).alias("manifest"))
