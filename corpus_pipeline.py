"""The corpus pipeline: documents through five operators, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheafline.llm.bpe_tree import bpe_round_trip
from sheafline.llm.common import forget, scratch, small_batches, stored
from sheafline.llm.language_tree import language_stage
from sheafline.llm.parsed_repeats import repeats_stage
from sheafline.llm.qgram_leaks import leaks_stage
from sheafline.llm.simhash_gray import near_dedup_stage


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token count and digests of each document that is left; see ``bpe_round_trip``."""
    import public_tokenizers

    small_batches(spark)
    return bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), digest=True)


STAGES = [
    ("language", language_stage),
    ("near_dedup", near_dedup_stage),
    ("repeats", repeats_stage),
    ("leaks", leaks_stage),
    ("encoding", encoding_stage),
]

#: No stage but the last drops or keeps rows by a rule that SQL can state; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again by the next.

    What a stage has read, and what it stored on its way, is deleted once its own
    output is written. The last output stays in the shared folder.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark) as kept:
            done = stored(stage(spark, docs, sf_dir), name)
            kept.append(done)
        if name != STAGES[0][0]:
            forget(spark, docs.stored_at)
        docs = done
    return docs
