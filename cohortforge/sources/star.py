"""Per-aliquot gene count files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortforge.functions.numeric import tidy_double
from cohortforge.functions.text import strip_version

# Numeric columns of the count files and the summary-row prefix.
VALUE_COLUMNS = [
    "unstranded",
    "stranded_first",
    "stranded_second",
    "tpm_unstranded",
    "fpkm_unstranded",
    "fpkm_uq_unstranded",
]
SUMMARY_PREFIX = "N_"


def read_counts(
    spark: SparkSession, path: str | list[str], value_column: str = "tpm_unstranded", positions: bool = False
) -> DataFrame:
    """(file_name, gene_id, gene, value) of every count file under a path.

    Summary rows are dropped; a non-numeric value is NULL.  ``gene_id`` stays the
    row key, since symbols repeat.  ``positions`` adds ``feature_pos``, which grows
    along each file.
    """
    if value_column not in VALUE_COLUMNS:
        raise ValueError(f"unknown value column {value_column!r}, choose from {VALUE_COLUMNS}")
    rows = spark.read.csv(path, sep="\t", comment="#", header=True, enforceSchema=False)
    lacking = {"gene_id", "gene_name", value_column} - set(rows.columns)
    if lacking:
        raise ValueError(f"count file lacks columns {sorted(lacking)}")
    position = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = rows.withColumn("feature_pos", F.col("_metadata.file_block_start") + position)
    return rows.filter(~F.col("gene_id").startswith(SUMMARY_PREFIX)).select(
        F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file_name"),
        strip_version(F.col("gene_id")).alias("gene_id"),
        F.col("gene_name").alias("gene"),
        *(["feature_pos"] if positions else []),
        tidy_double(F.col(value_column)).alias("value"),
    )


def with_barcodes(counts: DataFrame, manifest: DataFrame) -> DataFrame:
    """Count rows keyed by aliquot barcode through the file manifest."""
    joined = counts.join(manifest.select("file_name", "barcode"), "file_name")
    if "feature_pos" not in counts.columns:
        # Without positions, any fixed order of the genes; never negative, so it can be turned round.
        return joined.withColumn("feature_pos", F.xxhash64("gene_id").bitwiseAND(F.lit((1 << 62) - 1)))
    # One position for a gene in all files: the smallest of any.
    place = counts.groupBy("gene_id").agg(F.min("feature_pos").alias("feature_pos"))
    return joined.drop("feature_pos").join(place, "gene_id")
