"""Statistics that are fitted once and then frozen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortforge.functions.hashing import rows_checksum
from cohortforge.functions.numeric import ratio, tidy_double

MIN_SD = 1e-8


def fit(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """Per-gene mean and sample sd of each key's training cells.

    A spread under ``MIN_SD`` becomes NULL.  Keys with fewer than two samples
    get no scaler.  ``matrix`` has (keys, gene, sample_id, value).
    """
    stats = matrix.groupBy(*keys, "gene").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("_sd")
    )
    sizes = matrix.groupBy(*keys).agg(F.countDistinct("sample_id").alias("n_fit"))
    return (
        stats.join(sizes.filter(F.col("n_fit") >= 2), keys)
        .withColumn("sd", F.when(F.col("_sd") >= MIN_SD, F.col("_sd")))
        .select(*keys, "gene", "mean", "sd", "n_fit")
    )


def degenerate_genes(scaler: DataFrame, keys: list[str]) -> DataFrame:
    """Genes without usable spread; they standardise to a constant zero."""
    return scaler.filter(F.col("sd").isNull()).select(*keys, "gene")


def checksum(scaler: DataFrame, keys: list[str]) -> DataFrame:
    """Content hash of each frozen scaler, statistics rounded to ten decimals."""
    return rows_checksum(scaler, keys, "gene", ["gene", "mean", "sd"], "scaler_checksum")


def missing_genes(matrix: DataFrame, scaler: DataFrame, by: str, keys: list[str]) -> DataFrame:
    """Fitted genes a group's matrix lacks, per (group, scaler)."""
    groups = matrix.select(by).distinct()
    genes = scaler.select(*keys, "gene").distinct()
    wanted = genes.agg(F.collect_list(F.struct(*keys, "gene"))).scalar()
    every = groups.select(by, F.explode(wanted).alias("_w")).select(by, "_w.*")
    return every.join(matrix.select(by, "gene").distinct(), [by, "gene"], "left_anti")


def transform(matrix: DataFrame, scaler: DataFrame, keys: list[str]) -> DataFrame:
    """Standardise by frozen statistics; a missing value or missing spread becomes zero."""
    stats = scaler.select(*keys, "gene", "mean", "sd")
    on = ["gene", *[k for k in keys if k in matrix.columns]]
    z = ratio(tidy_double(F.col("value")) - F.col("mean"), F.col("sd"))
    return matrix.join(stats, on).withColumn("z", F.coalesce(z, F.lit(0.0)))


def build_reference(
    matrix: DataFrame, signatures: DataFrame, hashes: DataFrame, by: str = "cohort_id"
) -> DataFrame:
    """Freeze each (cohort, signature) as reference rows with the cohort's identity.

    ``hashes`` has (cohort, population_hash).
    """
    cells = matrix.join(signatures.select("signature", "gene", "scoring"), "gene")
    fitted = fit(cells, [by, "signature", "scoring"])
    return (
        fitted.join(hashes.select(by, "population_hash"), by)
        .withColumn("reference_id", F.concat_ws("/", by, "signature"))
        .withColumnRenamed(by, "reference_cohort")
    )


def score_reference(
    matrix: DataFrame,
    reference: DataFrame,
    by: str = "cohort_id",
    strict: bool = True,
) -> DataFrame:
    """Mean frozen z per sample and reference; valid for a single sample.

    ``reference`` has (reference_id, scoring, gene, mean, sd).  Only rowmean
    references are scored.  Strict mode skips groups that lack a fitted gene
    (see ``reference_refusals``); otherwise the genes in common are used.
    """
    usable = reference.filter(F.col("scoring") == "rowmean")
    status = _reference_status(matrix, usable, by, strict)
    admitted = status.filter(F.col("error_code") == "").select(by, "reference_id", "n_present")
    z = transform(matrix.select(by, "sample_id", "gene", "value"), usable, ["reference_id"])
    sums = z.groupBy(by, "reference_id", "sample_id").agg(F.sum("z").alias("_z"))
    samples = matrix.select(by, "sample_id").distinct()
    return (
        samples.join(admitted, by)
        .join(sums, [by, "reference_id", "sample_id"], "left")
        .select(
            by,
            "reference_id",
            "sample_id",
            (F.coalesce("_z", F.lit(0.0)) / F.col("n_present")).alias("score"),
            "n_present",
        )
    )


def _reference_status(matrix: DataFrame, reference: DataFrame, by: str, strict: bool) -> DataFrame:
    sizes = reference.groupBy("reference_id").agg(F.countDistinct("gene").alias("n_genes"))
    listed = sizes.agg(F.collect_list(F.struct("reference_id", "n_genes"))).scalar()
    every = (
        matrix.select(by).distinct().select(by, F.explode(listed).alias("_r")).select(by, "_r.*")
    )
    present = (
        matrix.select(by, "gene").distinct().join(reference.select("reference_id", "gene"), "gene")
        .groupBy(by, "reference_id").agg(F.count(F.lit(1)).alias("n_present"))
    )
    code = F.when(F.col("n_present") == 0, "no_reference_genes").when(
        F.lit(strict) & (F.col("n_present") < F.col("n_genes")), "missing_reference_genes"
    ).otherwise("")
    return (
        every.join(present, [by, "reference_id"], "left")
        .withColumn("n_present", F.coalesce("n_present", F.lit(0)))
        .withColumn("error_code", code)
    )


def reference_refusals(
    matrix: DataFrame, reference: DataFrame, by: str = "cohort_id", strict: bool = True
) -> DataFrame:
    """Groups a reference cannot score, with the reason; non-rowmean references included."""
    other = reference.filter(F.col("scoring") != "rowmean").select("reference_id").distinct()
    status = _reference_status(matrix, reference, by, strict)
    flagged = status.join(other.withColumn("_m", F.lit(True)), "reference_id", "left").withColumn(
        "error_code",
        F.when(F.col("_m"), "unsupported_method").otherwise(F.col("error_code")),
    )
    return flagged.filter(F.col("error_code") != "").select(by, "reference_id", "n_present", "error_code")
