"""Patient-level assembly: files to aliquots to patients, loss counted at every step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortforge.operators import harmonise


def landed(manifest: DataFrame, cells: DataFrame) -> DataFrame:
    """Manifest rows with a ``present`` flag telling whether any value landed."""
    have = cells.select("barcode").distinct().withColumn("present", F.lit(True))
    return manifest.join(have, "barcode", "left").withColumn(
        "present", F.coalesce("present", F.lit(False))
    )


def require_landed(manifest: DataFrame, cells: DataFrame, tolerate: int = 0) -> DataFrame:
    """Fail when more than ``tolerate`` manifest files have no values; else the cells."""
    missing = landed(manifest, cells).filter(~F.col("present"))
    n_failed = missing.count()
    if n_failed > tolerate:
        examples = [row["barcode"] for row in missing.orderBy("barcode").limit(5).collect()]
        raise ValueError(f"{n_failed} files failed, {tolerate} tolerated; first: {examples}")
    return cells


def assemble(
    cells: DataFrame,
    collapse: str = "max_mean",
    aliquot_rule: str = "first",
    primary_only: bool = True,
    by: str = "cohort_id",
) -> DataFrame:
    """Aliquot cells (cohort, gene, feature_pos, barcode, value) to patient cells.

    Duplicate symbols are collapsed over all aliquots first, then aliquots are
    selected and resolved to patients, in that order.
    """
    single = harmonise.collapse_duplicates(
        cells.withColumnRenamed("barcode", "sample_id"), collapse, by
    ).withColumnRenamed("sample_id", "barcode")
    parsed = harmonise.parse_barcodes(single)
    kept = harmonise.primary_samples(parsed) if primary_only else parsed.filter("patient is not null")
    return harmonise.to_patients(kept, aliquot_rule, [by, "gene"]).select(
        by, "gene", F.col("patient").alias("sample_id"), "value"
    )


def join_clinical(matrix: DataFrame, clinical: DataFrame) -> DataFrame:
    """Cells of patients that have a clinical row; no overlap at all is an error."""
    kept = matrix.join(clinical.select(F.col("patient").alias("sample_id")).distinct(), "sample_id", "left_semi")
    if kept.isEmpty():
        raise ValueError("no patient has both measurements and a clinical row")
    return kept


def loss_counts(manifest: DataFrame, cells: DataFrame, clinical: DataFrame) -> DataFrame:
    """One row per loss stage: files, primary samples, patients, clinical match.

    A single pass over aliquots and patients: the aliquot table is reduced to
    one row per patient before anything is counted.
    """
    parsed = harmonise.parse_barcodes(landed(manifest, cells))
    primary = F.coalesce(harmonise.is_primary(), F.lit(False)) & F.col("present")
    per_patient = parsed.groupBy("patient").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if("present").alias("landed"),
        F.count_if(primary).alias("primary"),
    )
    known = clinical.select("patient").distinct().withColumn("_clinical", F.lit(True))
    counted = per_patient.join(known, "patient", "left")
    has = F.col("primary") > 0
    totals = counted.agg(
        F.sum("files").alias("files"),
        F.sum("landed").alias("landed"),
        F.sum("primary").alias("primary"),
        F.count_if(has).alias("patients"),
        F.count_if(has & F.col("_clinical").isNotNull()).alias("joined"),
    )
    stages = [
        ("landed_files", "files", "landed"),
        ("primary_samples", "landed", "primary"),
        ("patients", "primary", "patients"),
        ("clinical_join", "patients", "joined"),
    ]
    rows = F.array(
        *[
            F.struct(F.lit(s).alias("stage"), F.col(a).alias("n_in"), F.col(b).alias("n_out"))
            for s, a, b in stages
        ]
    )
    return totals.select(F.inline(rows))
