"""Cohort build: the verbs in their fixed order, for many cohorts at once.

probes to symbols, symbols to the authority, scale, sample filters, endpoint,
analysis set, quality, expectations.  The order is part of the result: samples
are chosen before anything is standardised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortforge.functions.staging import written
from cohortforge.operators import endpoints, harmonise, quality


def build_cohorts(
    matrix: DataFrame,
    clinical: DataFrame,
    specs: DataFrame,
    aliases: DataFrame,
    probes: DataFrame | None = None,
    rules: list[dict] | None = None,
    signatures: DataFrame | None = None,
    expected: DataFrame | None = None,
    collapse: str = "max_mean",
    log2: bool | None = None,
) -> dict[str, DataFrame]:
    """Build cohorts from raw (cohort, feature, feature_pos, sample_id, value) cells.

    Returns ``matrix``, ``clinical``, ``counts``, ``findings``, ``coverage`` and
    ``violations`` tables.  ``log2`` forces the transform on or off; by default
    it applies to the cohorts found to be linear.
    """
    aligned = matrix.join(clinical.select("cohort_id", "sample_id"), ["cohort_id", "sample_id"], "left_semi")
    labelled = aligned
    if probes is not None:
        symbols = harmonise.map_probes(aligned, probes, collapse)
        # A gene stands where the first of its probes stood.
        first = harmonise.label_probes(aligned, probes).filter(F.col("gene").isNotNull()).groupBy("cohort_id", "gene").agg(
            F.min("feature_pos").alias("feature_pos")
        )
        labelled = symbols.join(first, ["cohort_id", "gene"]).select(
            "cohort_id", F.col("gene").alias("feature"), "feature_pos", "sample_id", "value"
        )
    resolved = harmonise.harmonise(labelled, aliases, collapse).select("cohort_id", "gene", "sample_id", "value")
    resolved = written(resolved, "resolved")
    if log2 is None:
        scaled = quality.log_if_linear(resolved, quality.infer_scale(resolved))
    elif log2:
        everything = resolved.select("cohort_id").distinct().withColumn("scale", F.lit("linear"))
        scaled = quality.log_if_linear(resolved, everything)
    else:
        scaled = resolved
    present = resolved.select("cohort_id", "sample_id").distinct()
    paired = clinical.join(present, ["cohort_id", "sample_id"], "left_semi")
    chosen = endpoints.apply_filters(paired, rules or [])
    derived = written(endpoints.derive(chosen, specs), "derived")
    kept = endpoints.analysis_set(derived)
    final = written(
        endpoints.restrict(scaled, kept).withColumn("feature_pos", F.lit(0).cast("long")), "cohort-matrix"
    )
    shape = final.groupBy("cohort_id").agg(
        F.countDistinct("gene").alias("n_genes"), F.countDistinct("sample_id").alias("n_samples")
    )
    report = endpoints.report(derived)
    built = shape.join(report.select("cohort_id", "n_events"), "cohort_id")
    out = {
        "matrix": final.drop("feature_pos"),
        "clinical": kept,
        "counts": endpoints.align_counts(present, derived),
        "endpoint_report": report,
        "findings": quality.findings(final, kept.select("cohort_id", "sample_id", "event")),
    }
    if rules:
        out["filters"] = endpoints.filter_report(paired, rules)
    if signatures is not None:
        out["coverage"] = quality.coverage_findings(final, signatures)
    if expected is not None:
        out["violations"] = quality.check_expectations(built, expected)
    return out
