"""Registered queries of the text operators, over whole tables, with their SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortforge.llm.decontaminate import OVERLAP_SQL
from cohortforge.llm.line_dedup import DEDUP_SQL
from cohortforge.llm.substring_dedup import DEDUP_SQL as SUBSTRING_SQL


def tokenizer(name: str) -> str:
    """Path of an installed tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents through a digest cache."""
    from cohortforge.llm.token_counts import count_tokens

    counts = count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids."""
    from cohortforge.llm.packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op8_sequence_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to Arrow stream files and read back."""
    from cohortforge.llm.sequence_files import read_documents, write_sequences

    manifest = write_sequences(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return read_documents(manifest).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after deleting later copies of repeated line runs."""
    from cohortforge.llm.line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return out.select("doc_id", "n_lines", "n_removed", digest)


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one, by integer inner product."""
    from cohortforge.llm.top_k import top_k, usable

    rows = table(spark, sf_dir, "embeddings").where(usable(F.col("embedding")))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    return top_k(rows.select("vec_id", whole.alias("vector")), F.col("vec_id") % 50 == 0)


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after removing runs of 13 words that an earlier one has."""
    from cohortforge.llm.substring_dedup import dedup_substrings

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    from cohortforge.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from two thirds of the labels."""
    from cohortforge.llm.features import id_remainder
    from cohortforge.llm.quality import fit, score

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(id_remainder(F.col("doc_id"), 3) != 1))
    held = F.coalesce(id_remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    return score(docs.select("doc_id", "text"), model).select("doc_id", held, "score", "predicted")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item of which it holds a passage."""
    from cohortforge.llm.decontaminate import overlaps

    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learnt from three quarters of them."""
    from cohortforge.llm.features import id_remainder
    from cohortforge.llm.language import fit, predict

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, id_remainder(F.col("doc_id"), 4) != 2)
    held = F.coalesce(id_remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held, "lang_pred", "score")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between the tokens of two tokenizers in all documents, with their corpus-wide counts."""
    from cohortforge.llm.alignment import align

    return align(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in all documents, every tenth of which (by its id's hash) is made periodic first."""
    from cohortforge.llm.periodic_runs import made_periodic, periodic_runs

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic_runs(docs, rewrite=made_periodic, with_text=False).drop("runs", "collapsed")


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose shingle sets agree to 80 percent."""
    from cohortforge.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_top_k": (op1_top_k, TOP_K_SQL),
    "op2_token_counts": (op2_token_counts, None),
    "op3_packing": (op3_packing, None),
    "op4_line_dedup": (op4_line_dedup, DEDUP_SQL),
    "op5_substring_dedup": (op5_substring_dedup, SUBSTRING_SQL),
    "op6_quality": (op6_quality, None),
    "op7_near_duplicates": (op7_near_duplicates, None),
    "op8_sequence_files": (op8_sequence_files, None),
    "op9_decontaminate": (op9_decontaminate, OVERLAP_SQL),
    "op10_language": (op10_language, None),
    "op11_alignment": (op11_alignment, None),
    "op12_periodic_runs": (op12_periodic_runs, None),
    "op13_jaccard_join": (op13_jaccard_join, None),
}
