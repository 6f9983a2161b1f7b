"""A corpus cleaning pipeline: five stages of the operators in ``tessella.llm``.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.  All but
the last return the columns of ``docs``; ``run`` writes each result to the shared folder and
reads it back, so a lost executor costs a reread.

No SQL states the whole: language labels and shingle links have no SQL form.  The pipeline is
tested against brute-force versions of its stages instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.common import prepare, stash
from tessella.llm.crf import keep_identified
from tessella.llm.minhash import drop_near_duplicates
from tessella.llm.packing import pack, token_pieces
from tessella.llm.passages import drop_repeats
from tessella.llm.secrets import redact


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language can be told; null, blank and letterless texts go."""
    return keep_identified(docs, least=0.4)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts alike by 0.8 or more of their five-word shingles."""
    return drop_near_duplicates(docs, size=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that an earlier document has."""
    return drop_repeats(docs, least=50, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets replaced; every row stays."""
    return redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all texts with their places in sequences of 4096."""
    packed, _ = pack(token_pieces(docs))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("secret_scan", secret_scan), ("best_fit_packing", best_fit_packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
