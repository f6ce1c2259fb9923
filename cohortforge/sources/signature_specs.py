"""Signature specifications: JSON scan, validation, checksum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortforge.functions.hashing import tagged_sha

SCHEMA = (
    "name string, genes array<string>, scoring string, "
    "coefficients map<string,double>, checksum string, notes string, "
    "symbol_authority string, source map<string,string>"
)
VALID_SCORING = ["rowmean", "median_z", "weighted"]


def read(spark: SparkSession, path: str) -> DataFrame:
    """Specs from JSON documents, one signature each."""
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path)


def checksum_column(genes: Column | str, coefficients: Column) -> Column:
    """Checksum of one spec row: sorted genes, then sorted ``gene=coefficient`` lines."""
    names = F.array_sort(F.transform(F.col(genes) if isinstance(genes, str) else genes, lambda g: F.trim(g)))
    entries = F.array_sort(F.map_entries(coefficients))
    lines = F.transform(entries, lambda e: F.format_string("%s=%.9f", e["key"], e["value"]))
    both = F.concat(names, F.coalesce(lines, F.array().cast("array<string>")))
    return tagged_sha(F.array_join(both, "\n"))


def validate(specs: DataFrame) -> DataFrame:
    """One row per spec with its first error, or none.

    The order of the checks is part of the contract: name, gene list, duplicate
    genes, coefficient cover, scoring, checksum.
    """
    trimmed = F.transform("genes", lambda g: F.trim(g))
    genes = F.coalesce(trimmed, F.array().cast("array<string>"))
    covered = F.map_keys("coefficients")
    exact = (F.size(F.array_except(covered, "_genes")) == 0) & (
        F.size(F.array_except("_genes", covered)) == 0
    )
    weighted = F.col("coefficients").isNotNull()
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    code = (
        F.when(blank("name"), "missing_name")
        .when(F.size("_genes") == 0, "empty_gene_list")
        .when(F.size(F.array_distinct("_genes")) != F.size("_genes"), "duplicate_genes")
        .when(weighted & ~exact, "coefficients_not_exact")
        .when(blank("scoring"), "missing_scoring")
        .when(~F.col("scoring").isin(VALID_SCORING), "unknown_scoring")
        .when((F.col("scoring") == "weighted") & ~weighted, "weighted_without_coefficients")
        .when(blank("checksum"), "missing_checksum")
        .when(F.col("checksum") != checksum_column("_genes", F.col("coefficients")), "checksum_mismatch")
        .otherwise("")
    )
    return (
        specs.withColumn("_genes", genes)
        .withColumn("error_code", code)
        .select(
            F.col("name").alias("signature"),
            (F.col("error_code") == "").alias("ok"),
            "error_code",
            F.size("_genes").cast("long").alias("n_genes"),
        )
    )


def to_rows(specs: DataFrame) -> DataFrame:
    """Valid specs as (signature, gene, gene_pos, coefficient, scoring, checksum) rows."""
    good = validate(specs).filter("ok").select(F.col("signature").alias("name"))
    return (
        specs.join(good, "name", "left_semi")
        .select("name", "scoring", "checksum", "coefficients", F.posexplode("genes").alias("gene_pos", "_g"))
        .select(
            F.col("name").alias("signature"),
            F.trim("_g").alias("gene"),
            "gene_pos",
            F.col("coefficients")[F.trim("_g")].alias("coefficient"),
            "scoring",
            "checksum",
        )
    )
