"""Corpus preparation: each stage takes the documents its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortforge.llm.stages import dedup_lines, dedup_near, drop_leaks, keep_languages, pack_sequences

STAGES = [
    ("language_id", keep_languages),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontamination", drop_leaks),
    ("packing", pack_sequences),
]

#: Tokenizer files and a trained language model have no SQL form; tests compare every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
