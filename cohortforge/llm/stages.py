"""Stages of the corpus pipeline: ``(spark, docs, sf_dir) -> DataFrame``.

All but the last return the columns of documents. Each one works on whatever its
predecessor kept; nulls, empty texts and repeated rows fare as the operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortforge.llm import decontaminate, language, line_dedup, near_dup, packing
from cohortforge.llm.features import id_remainder
from cohortforge.llm.queries import table, tokenizer
from cohortforge.llm.tables import ascii_words, written


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that language identification rejects: no letters, or no language that is sure enough.

    Without a labelled row no language can be learnt; then only documents without letters go.
    """
    model = language.fit(docs, id_remainder(F.col("doc_id"), 4) != 2)
    if not model.labels:
        return docs.where(docs["text"].rlike("\\p{L}"))
    return language.predict(docs, model).where("accepted").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later copies of repeated line runs; a document with nothing else goes.

    ``n_chars``, where there is one, is counted anew for the texts that change.
    """
    out = line_dedup.dedup_lines(docs)
    changed = F.col("n_removed") > 0
    out = out.where(~changed | (F.size(ascii_words(F.col("text"))) > 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group, that of the smallest id; a similarity of 0.8 or more links.

    Rows that repeat an id (null ids included) and its text are one document: one row stays.
    """
    dropped = near_dup.near_duplicates(docs, percent=80).where(~F.col("kept")).select(F.col("doc_id").alias("_dropped")).distinct()
    kept = docs.join(dropped, docs["doc_id"] == dropped["_dropped"], "left_anti")
    often = docs.groupBy(F.col("doc_id").alias("_often")).count().where("count > 1").select("_often")
    if often.isEmpty():
        return kept
    often = written(often, "repeated-ids")
    repeats = kept.join(often, kept["doc_id"].eqNullSafe(often["_often"]), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(often, kept["doc_id"].eqNullSafe(often["_often"]), "left_anti").unionAll(repeats)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of a benchmark item.

    Null texts and rows with a null id stay; so does everything if there are no items.
    """
    found = decontaminate.overlaps(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(found, docs["doc_id"] == found["_leak"], "left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 ids; a row for each piece, with its ids' checksum."""
    pieces = packing.pack(docs, tokenizer("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
