"""The corpus pipeline: language ID, near-dedup, decontamination, PII and BPE, each on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelframe.llm.bpe import stage_bpe
from reelframe.llm.decontaminate import stage_decontaminate
from reelframe.llm.language import stage_language
from reelframe.llm.minhash import stage_dedup
from reelframe.llm.pii import stage_pii

STAGES = [
    ("language", stage_language),
    ("dedup", stage_dedup),
    ("decontaminate", stage_decontaminate),
    ("pii", stage_pii),
    ("bpe", stage_bpe),
]

#: SQL can't express the trained and hashed stages; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
