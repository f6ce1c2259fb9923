"""Delimited tables: endpoint resource, local matrices, alias tables, symbol authority."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortforge.functions.numeric import tidy_double
from cohortforge.functions.text import unquote
from cohortforge.sources.lines import fields, melt, numbered_lines, split_header

# Retired-symbol columns of the authority table.
AUTHORITY_ALIASES = {"prev_symbol": "previous", "alias_symbol": "alias"}


def read_endpoint_table(spark: SparkSession, path: str) -> DataFrame:
    """Clinical data resource as strings with a ``line_no``; TSV, TXT or CSV."""
    sep = "," if path.lower().endswith(".csv") else "\t"
    rows = spark.read.csv(path, sep=sep, header=True)
    if "bcr_patient_barcode" not in rows.columns:
        raise ValueError("not an endpoint table: no bcr_patient_barcode column")
    position = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("line_no", F.col("_metadata.file_block_start") + position)


def read_local_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Wide genes-by-samples file as (feature, feature_pos, sample_id, value)."""
    header, body = split_header(_present(numbered_lines(spark, path)), "\t")
    return melt(header, body).select(
        F.col("row_label").alias("feature"),
        F.col("line_no").alias("feature_pos"),
        F.col("column").alias("sample_id"),
        tidy_double(F.col("raw")).alias("value"),
    )


def read_local_clinical(spark: SparkSession, path: str) -> DataFrame:
    """All-string clinical file as (sample_id, attrs); empty cells are missing."""
    header, body = split_header(_present(numbered_lines(spark, path)), "\t")
    cells = melt(header, body).withColumn("v", F.when(F.col("raw") != "", F.col("raw")))
    # A column or a sample listed twice has its last value.
    single = cells.groupBy("row_label", "column").agg(F.max(F.struct("line_no", "pos", "v"))["v"].alias("v"))
    return single.groupBy(F.col("row_label").alias("sample_id")).agg(
        F.map_from_entries(F.collect_list(F.struct("column", "v"))).alias("attrs")
    )


def _present(lines: DataFrame) -> DataFrame:
    return lines.filter(F.trim("line") != "")


def strict_matrix_problems(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """Reasons an inference matrix file must be refused: header and row-label checks."""
    sep = "," if path.lower().endswith(".csv") else "\t"
    header, body = split_header(_present(numbered_lines(spark, path)), sep)
    genes = F.array(*[F.lit(g) for g in required])
    names = F.transform("header", lambda h: unquote(h))
    samples = F.slice(names, 2, F.greatest(F.size(names) - 1, F.lit(0)))
    head_code = (
        F.when(F.size("header") < 2, "no_sample_columns")
        .when(F.exists(samples, lambda s: s == ""), "blank_sample")
        .when(F.size(F.array_distinct(samples)) < F.size(samples), "duplicate_sample")
        .when(
            F.lower(names[0]).isin("sample", "sample_id") | F.arrays_overlap(samples, genes),
            "samples_as_rows",
        )
    )
    heads = header.select("file", head_code.alias("problem"))
    blank = body.filter(unquote(fields(F.col("line"), sep)[0]) == "").select(
        "file", F.lit("blank_gene").alias("problem")
    ).distinct()
    return heads.filter(F.col("problem").isNotNull()).unionByName(blank)


def read_strict_matrix(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """(sample_id, gene, value) of a checked genes-by-samples inference file."""
    problems = strict_matrix_problems(spark, path, required).limit(5).collect()
    if problems:
        raise ValueError("matrix refused: " + ", ".join(p["problem"] for p in problems))
    sep = "," if path.lower().endswith(".csv") else "\t"
    header, body = split_header(_present(numbered_lines(spark, path)), sep)
    return melt(header, body, sep).select(
        F.col("column").alias("sample_id"),
        F.col("row_label").alias("gene"),
        F.col("raw").try_cast("double").alias("value"),
    )


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(alias, approved array in file order); aliases upper-cased, comments and header skipped."""
    lines = _present(numbered_lines(spark, path)).filter(~F.col("line").startswith("#"))
    parts = fields(F.col("line"))
    rows = lines.select(
        "line_no", F.upper(F.trim(parts[0])).alias("alias"), F.trim(F.get(parts, F.lit(1))).alias("approved")
    ).filter(F.col("alias") != "ALIAS")
    first = rows.groupBy("alias", "approved").agg(F.min("line_no").alias("line_no"))
    return first.groupBy("alias").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("line_no", "approved"))), lambda s: s["approved"]).alias("approved")
    )


def build_authority(spark: SparkSession, path: str) -> DataFrame:
    """(alias, approved, kind) rows from a complete symbol authority table."""
    table = spark.read.csv(path, sep="\t", header=True)
    lacking = {"symbol", "status"} - set(table.columns)
    if lacking:
        raise ValueError(f"authority table lacks columns {sorted(lacking)}")
    approved = table.filter(F.col("status") == "Approved")
    kinds = [
        F.struct(F.lit(kind).alias("kind"), F.col(column).alias("raw"))
        for column, kind in AUTHORITY_ALIASES.items()
        if column in table.columns
    ]
    symbol = F.trim("symbol")
    return (
        approved.select(symbol.alias("approved"), F.inline(F.array(*kinds)))
        .select("approved", "kind", F.explode(F.split(unquote(F.col("raw")), r"\|")).alias("alias"))
        .select(F.upper(F.trim("alias")).alias("alias"), "approved", "kind")
        .filter((F.col("alias") != "") & (F.col("alias") != F.upper("approved")))
    )


def ambiguous_aliases(authority: DataFrame) -> DataFrame:
    return authority.groupBy("alias").agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)
