"""Token counts through a cache keyed by content and tokenizer digests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortforge.llm.segments import encoder, file_digest
from cohortforge.llm.tables import fresh_path, written
from cohortforge.llm.text import slices

CACHE_SCHEMA = "content binary, tokenizer string, n_tokens long"


def normalised(text: Column) -> Column:
    """Content that is digested: null becomes the empty text, all else stays as it is,
    as any other change could alter the count."""
    return F.coalesce(text, F.lit(""))


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for at, texts in slices(batch.column("_text")):
                counts = np.diff(encode.batch(texts)[1])
                content = batch.column("_content").slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([content, pa.array(counts, pa.int64())], names=["content", "n_tokens"])

    return run


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    cache_path: str | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per input row: the id, ``n_bytes`` and ``n_tokens`` of its whole text.

    Counts come from the table at ``cache_path`` (a new one if None). Texts without a
    stored count under this tokenizer's digest are encoded once per distinct content and
    appended. Null texts count as empty (0 tokens); null ids and repeated rows are kept;
    an empty table gives an empty result; other columns of ``docs`` are not read.

    Texts are shuffled by (id, content digest), which no group of copies can overfill;
    the copies themselves meet only as digests, in a join that may split hot keys.
    """
    spark = docs.sparkSession
    cache_path = cache_path or fresh_path(spark, "token-cache")
    version = file_digest(tokenizer_path)
    text = normalised(docs[text_column])
    rows = docs.select(
        docs[id_column].alias("_id"), text.alias("_text"), F.unhex(F.sha2(text, 256)).alias("_content")
    )
    digests = written(
        rows.select("_id", F.octet_length("_text").cast("long").alias("n_bytes"), "_content"), "token-digests"
    )
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version)
    distinct = digests.groupBy("_content").agg(F.min("_id").alias("_id"))
    misses = written(distinct.join(stored, distinct["_content"] == stored["content"], "left_anti"), "token-misses")
    wanted = misses.select(F.col("_id").alias("_miss_id"), F.col("_content").alias("_miss"))
    found = rows.join(wanted, (F.col("_content") == F.col("_miss")) & F.col("_id").eqNullSafe(F.col("_miss_id")))
    fresh = found.select("_content", "_text").mapInArrow(_counter(tokenizer_path), "content binary, n_tokens long")
    fresh = written(fresh.groupBy("content").agg(F.max("n_tokens").alias("n_tokens")), "token-fresh")
    fresh.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version)
    known = written(stored.groupBy("content").agg(F.max("n_tokens").alias("n_tokens")), "token-known")
    joined = digests.join(known, digests["_content"] == known["content"])
    return joined.select(F.col("_id").alias(id_column), "n_bytes", "n_tokens")
