"""Cohort-relative signature scores.

A score is relative to the population it is computed over: filter samples
first, score second.  Nothing here may be applied to an open stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortforge.functions.numeric import ratio, tidy_double
from cohortforge.functions.staging import written

METHODS = ("rowmean", "weighted", "median_z")
MIN_GENES = 3
MIN_BATCH_SAMPLES = 20


def _require_batch(df: DataFrame) -> None:
    if df.isStreaming:
        raise ValueError("a cohort-relative score needs a closed population, not a stream")


def keep_signature_genes(expression: DataFrame, signatures: DataFrame) -> DataFrame:
    """The cells of signature genes; the gene list is small, so the planner need not shuffle the matrix."""
    return expression.join(signatures.select("gene").distinct(), "gene", "left_semi").select(*expression.columns)


def coverage(
    expression: DataFrame, signatures: DataFrame, by: str = "cohort_id", min_genes: int = MIN_GENES
) -> DataFrame:
    """Found and missing genes per (cohort, signature), and whether scoring is refused.

    ``n_found`` counts genes present in the matrix, before any zero-variance
    gene drops out.
    """
    present = expression.select(by, "gene").distinct()
    wanted = signatures.select("signature", "gene").distinct()
    found = (
        present.join(wanted, "gene")
        .groupBy(by, "signature")
        .agg(F.collect_set("gene").alias("_found"))
    )
    # The signature list is a small dimension: one scalar array, exploded per group.
    listed = (
        wanted.groupBy("signature")
        .agg(F.array_sort(F.collect_set("gene")).alias("listed"))
        .agg(F.collect_list(F.struct("signature", "listed")))
        .scalar()
    )
    every = (
        present.select(by).distinct()
        .select(by, F.explode(listed).alias("_s"))
        .select(by, F.col("_s.signature").alias("signature"), F.col("_s.listed").alias("_listed"))
    )
    n_found = F.when(F.col("_found").isNull(), 0).otherwise(F.size("_found"))
    missing = F.when(F.col("_found").isNull(), F.col("_listed")).otherwise(
        F.array_except("_listed", "_found")
    )
    return every.join(found, [by, "signature"], "left").select(
        by,
        "signature",
        n_found.cast("long").alias("n_found"),
        F.size("_listed").cast("long").alias("n_total"),
        (n_found / F.size("_listed")).alias("coverage"),
        missing.alias("missing"),
        (n_found < min_genes).alias("refused"),
    )


def _for_population(
    scores: DataFrame, expression: DataFrame, population: DataFrame | None, by: str
) -> DataFrame:
    """One row per scored (group, signature) and every sample of the group.

    A sample without any signature cell is part of the population all the same.
    Pass ``population`` (group, sample) when it is at hand; it is derived from
    the matrix otherwise.
    """
    scores = written(scores, "scores")
    samples = (population if population is not None else expression).select(by, "sample_id").distinct()
    groups = written(scores.select(by, "signature").distinct(), "scored-groups")
    return samples.join(groups, by).join(scores, [by, "signature", "sample_id"], "left")


def _usable(expression: DataFrame, signatures: DataFrame, by: str, min_genes: int) -> DataFrame:
    """Signature cells of groups that reach the gene floor, with gene statistics."""
    wanted = keep_signature_genes(expression, signatures)
    cells = wanted.select(by, "gene", "sample_id", tidy_double(F.col("value")).alias("value")).join(
        signatures.select("signature", "gene", "coefficient", "scoring"), "gene"
    )
    # The window holds one (group, signature)'s genes, never its samples.
    genes = Window.partitionBy(by, "signature")
    stats = (
        cells.groupBy(by, "signature", "gene")
        .agg(F.avg("value").alias("_mean"), _spread("value").alias("_sd"))
        .withColumn("_g", F.count(F.lit(1)).over(genes))
        .filter(F.col("_g") >= min_genes)
        .drop("_g")
    )
    # Written, so the planner knows its size: small statistics are broadcast and
    # the cells are not shuffled; large ones fall back to a shuffled join.
    stats = written(stats, "gene-statistics")
    return cells.join(stats, [by, "signature", "gene"])


def _spread(value: str) -> Column:
    """Sample sd, zero where values don't differ; merged from partial sums it need not be."""
    return F.when(F.min(value) == F.max(value), F.stddev_samp(value) * 0).otherwise(F.stddev_samp(value))


def _z(value: Column) -> Column:
    return F.when(F.col("_sd") != 0, ratio(value - F.col("_mean"), F.col("_sd")))


def score_rowmean(
    expression: DataFrame,
    signatures: DataFrame,
    by: str = "cohort_id",
    min_genes: int = MIN_GENES,
    population: DataFrame | None = None,
) -> DataFrame:
    """Mean over signature genes of the per-gene z-score, nulls skipped."""
    _require_batch(expression)
    usable = _usable(expression, signatures, by, min_genes)
    scores = usable.groupBy(by, "signature", "sample_id").agg(
        F.avg(_z(F.col("value"))).alias("score")
    )
    return _for_population(scores, expression, population, by)


def score_weighted(
    expression: DataFrame,
    signatures: DataFrame,
    by: str = "cohort_id",
    min_genes: int = MIN_GENES,
    population: DataFrame | None = None,
) -> DataFrame:
    """Sum of coefficient times z; a sample with no usable value scores zero."""
    _require_batch(expression)
    weighted = signatures.filter(F.col("coefficient").isNotNull())
    usable = _usable(expression, weighted, by, min_genes)
    scores = usable.groupBy(by, "signature", "sample_id").agg(
        F.sum(F.col("coefficient") * _z(F.col("value"))).alias("score")
    )
    return _for_population(scores, expression, population, by).withColumn(
        "score", F.coalesce("score", F.lit(0.0))
    )


def score_median_z(
    expression: DataFrame,
    signatures: DataFrame,
    by: str = "cohort_id",
    min_genes: int = MIN_GENES,
    population: DataFrame | None = None,
) -> DataFrame:
    """Per-sample median of raw values, standardised across the cohort's samples.

    The median's group is one sample's signature genes, so its state is small.
    """
    _require_batch(expression)
    usable = _usable(expression, signatures, by, min_genes)
    medians = usable.groupBy(by, "signature", "sample_id").agg(F.median("value").alias("_median"))
    spread = medians.groupBy(by, "signature").agg(
        F.avg("_median").alias("_mean"), _spread("_median").alias("_sd")
    )
    scores = medians.join(spread, [by, "signature"]).select(
        by,
        "signature",
        "sample_id",
        ratio(F.col("_median") - F.col("_mean"), F.col("_sd")).alias("score"),
    )
    return _for_population(scores, expression, population, by)


def score(
    expression: DataFrame,
    signatures: DataFrame,
    by: str = "cohort_id",
    population: DataFrame | None = None,
) -> DataFrame:
    """Score every signature with the method it declares."""
    out = None
    for method, verb in (
        ("rowmean", score_rowmean),
        ("weighted", score_weighted),
        ("median_z", score_median_z),
    ):
        part = verb(
            expression, signatures.filter(F.col("scoring") == method), by, population=population
        ).withColumn("method", F.lit(method))
        out = part if out is None else out.unionByName(part)
    return out


def score_batches(
    expression: DataFrame,
    signatures: DataFrame,
    by: str = "batch_id",
    min_samples: int = MIN_BATCH_SAMPLES,
) -> tuple[DataFrame, DataFrame]:
    """Score batches that reach the sample floor; list every batch with its verdict."""
    _require_batch(expression)
    sizes = (
        expression.select(by, "sample_id").distinct().groupBy(by)
        .agg(F.count(F.lit(1)).alias("n_samples"))
        .withColumn("refused", F.col("n_samples") < min_samples)
    )
    admitted = expression.join(sizes.filter(~F.col("refused")).select(by), by, "left_semi")
    return score(admitted, signatures, by), sizes
