"""The queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, crf, gru, oracles, periodic, resampling, toxicity
from .common import table
from .minhash import near_duplicates
from .mpeg import read_audio, to_audio
from .passages import repeats
from .packing import pack, token_pieces
from .pieces import segmentations
from .secrets import find_secrets
from .topk import top_k


def op1_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))


def op2_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_audio(to_audio(table(spark, sf_dir, "documents"))).withColumnRenamed("key", "doc_id")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed, _ = pack(token_pieces(table(spark, sf_dir, "documents")))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op6_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op7_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.identify(table(spark, sf_dir, "documents"))


def op8_n_best_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentations(table(spark, sf_dir, "documents"))


def op9_recurrent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru.score(table(spark, sf_dir, "documents"))


def op10_credential_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.withColumnRenamed("key", "doc_id")


def op12_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(chat.windows(talk))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(periodic.planted(table(spark, sf_dir, "documents")), key="key")
    found = found.withColumn("best", periodic.strongest(F.col("runs")))
    told = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.select(
        F.col("key").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}") for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op5_bit_sliced_top_k": oracles.TOP_K, "op6_superminhash": oracles.NEAR_DUPLICATES, "op11_importance_resampling": oracles.RESAMPLING, "op12_chat_windows": oracles.CHAT}
