"""Quality findings as a table, and inference of a matrix's value scale.

All rules share three small aggregates (per gene, per sample, per cohort); no
rule windows over raw cells.  In the sparse long form an absent cell is missing
only if its gene and its sample both occur in the cohort, so missingness is
counted against genes times samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortforge.functions.numeric import finite, ratio
from cohortforge.functions.staging import written
from cohortforge.operators.endpoints import top_examples
from cohortforge.operators.ordering import exact_quantiles

# Thresholds of the scale decision and of the findings.
LOG_MAX_PLAUSIBLE = 30.0
INTEGER_TOLERANCE = 1e-9
MAX_EVENT_RATE = 0.85
MAX_GENE_MISSING = 0.20
MAX_SAMPLE_MISSING = 0.20
MIN_COVERAGE = 0.90
MIN_SAMPLES = 30
MIN_EVENTS = 10


def infer_scale(matrix: DataFrame, by: str = "cohort_id") -> DataFrame:
    """Scale and assay family per cohort, from every value (never a subsample)."""
    # A non-finite value becomes NULL, so a cohort without any finite one stays, as unknown.
    values = matrix.select(by, F.when(finite(F.col("value")), F.col("value")).alias("value"))
    shape = values.groupBy(by).agg(
        F.min("value").alias("minimum"),
        F.max("value").alias("maximum"),
        F.avg((F.col("value") < 0).cast("double")).alias("frac_negative"),
        F.bool_and(F.abs(F.col("value") - F.round("value")) < INTEGER_TOLERANCE).alias("integer_valued"),
    )
    medians = exact_quantiles(values, [by], "value", {"median": 0.5})
    top = F.col("maximum")
    linear = top > LOG_MAX_PLAUSIBLE
    counts = linear & F.col("integer_valued")
    z = (F.col("frac_negative") > 0.4) & (F.abs("median") < 0.5) & (top < 10)
    scale = F.when(top.isNull(), "unknown").when(linear, "linear").when(z, "z").otherwise("log")
    assay = (
        F.when(top.isNull(), "unknown")
        .when(counts, "rna-seq-counts")
        .when(linear, "rna-seq-normalised")
        .when(z, "unknown")
        .when(F.col("frac_negative") > 0.01, "array")
        .otherwise("rna-seq-normalised")
    )
    advice = (
        F.when(counts, "normalise and log-transform raw counts before scoring")
        .when(linear, "apply log2(x + 1) before scoring")
        .when(F.col("scale") == "z", "already standardised over an unrecorded population")
    )
    return (
        shape.join(medians, by, "left")
        .withColumn("scale", scale)
        .withColumn("assay", assay)
        .withColumn("recommendation", advice)
        .withColumn("sampled", F.lit(False))
    )


def log_if_linear(matrix: DataFrame, scales: DataFrame, by: str = "cohort_id") -> DataFrame:
    """log2(max(x, 0) + 1) for cohorts on a linear scale, applied once; others unchanged."""
    linear = scales.filter(F.col("scale") == "linear").select(by, F.lit(True).alias("_linear"))
    # One row per linear cohort, of known size, so the matrix itself is not shuffled.
    linear = written(linear, "linear-cohorts")
    logged = F.log2(F.greatest(F.col("value"), F.lit(0.0)) + 1.0)
    logged = F.when(F.col("value").isNotNull(), logged)
    return matrix.join(linear, by, "left").withColumn(
        "value", F.when(F.col("_linear"), logged).otherwise(F.col("value"))
    ).drop("_linear")


def log2_transform(matrix: DataFrame, pseudocount: float = 1.0) -> DataFrame:
    """log2(x + pseudocount) without clipping; non-positive arguments become NULL."""
    return matrix.withColumn("value", F.log2(F.col("value") + F.lit(float(pseudocount))))


def log2_losses(matrix: DataFrame, pseudocount: float = 1.0, by: str = "cohort_id") -> DataFrame:
    """Values ``log2_transform`` cannot represent, per cohort."""
    return matrix.groupBy(by).agg(
        F.count_if(F.col("value") + F.lit(float(pseudocount)) <= 0).alias("n_lost")
    )


def _profiles(matrix: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    genes = matrix.groupBy(by, "gene").agg(
        F.count("value").alias("n_values"),
        _flat().alias("flat"),
        F.countDistinct("feature_pos").alias("n_rows"),
    )
    samples = matrix.groupBy(by, "sample_id").agg(F.count("value").alias("n_values"), _flat().alias("flat"))
    return genes, samples


def _flat() -> Column:
    """Whether a group's values don't differ; so too for a group without any.

    A variance merged from partial sums need not be zero for equal values: 1 / 49 * 49 isn't 1.
    """
    low, high = F.min("value"), F.max("value")
    return F.coalesce((low == high) & ~F.isnan(high), F.lit(True))


def _finding(df: DataFrame, by: str, level: Column, code: str, n: Column) -> DataFrame:
    return df.select(
        by, level.alias("level"), F.lit(code).alias("code"), n.cast("double").alias("n")
    )


def findings(
    matrix: DataFrame,
    endpoint: DataFrame | None = None,
    by: str = "cohort_id",
    min_samples: int = MIN_SAMPLES,
    min_events: int = MIN_EVENTS,
) -> DataFrame:
    """Findings (cohort, level, code, n, examples) of the structural and endpoint rules.

    ``matrix`` has (cohort, gene, feature_pos, sample_id, value); ``endpoint``
    has (cohort, sample_id, event).
    """
    genes, samples = _profiles(matrix, by)
    genes, samples = written(genes, "gene-profile"), written(samples, "sample-profile")
    shape = genes.groupBy(by).agg(
        F.sum("n_rows").alias("n_genes"), F.sum("n_values").alias("n_cells")
    ).join(samples.groupBy(by).agg(F.count(F.lit(1)).alias("n_samples")), by)
    shape = written(shape, "cohort-shape")
    sized = shape.select(by, "n_genes", "n_samples")

    gene_bad = genes.join(sized, by).filter(
        1 - F.col("n_values") / (F.col("n_samples") * F.col("n_rows")) > MAX_GENE_MISSING
    )
    sample_bad = samples.join(sized, by).filter(
        1 - F.col("n_values") / F.col("n_genes") > MAX_SAMPLE_MISSING
    )
    flat_genes = genes.filter("flat")
    flat_samples = samples.filter("flat")

    def listed(df: DataFrame, level: str, code: str, name: str) -> DataFrame:
        tally = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
        head = _finding(tally, by, F.lit(level), code, F.col("_n"))
        return head.join(top_examples(df, [by], name, 10, "examples"), by)

    bare = F.array().cast("array<string>").alias("examples")
    parts = [
        listed(gene_bad, "WARN", "gene_missingness", "gene"),
        listed(sample_bad, "FAIL", "sample_missingness", "sample_id"),
        listed(flat_genes, "WARN", "zero_variance", "gene"),
        listed(flat_samples, "FAIL", "flat_samples", "sample_id"),
    ]
    duplicates = genes.filter(F.col("n_rows") > 1).groupBy(by).agg(
        F.sum(F.col("n_rows") - 1).alias("_n")
    )
    parts.append(_finding(duplicates, by, F.lit("FAIL"), "duplicate_genes", F.col("_n")).select("*", bare))
    few = shape.filter(F.col("n_samples") < min_samples)
    parts.append(_finding(few, by, F.lit("FAIL"), "n_samples", F.col("n_samples")).select("*", bare))
    missing = 1 - F.col("n_cells") / (F.col("n_genes") * F.col("n_samples"))
    parts.append(_finding(shape, by, F.lit("INFO"), "frac_missing", missing).select("*", bare))
    advised = infer_scale(matrix, by).filter(F.col("recommendation").isNotNull())
    parts.append(
        _finding(advised, by, F.lit("WARN"), "scale", F.col("maximum")).select("*", bare)
    )
    if endpoint is not None:
        events = endpoint.groupBy(by).agg(
            F.count("event").alias("n_scored"),
            F.coalesce(F.sum("event"), F.lit(0)).alias("n_events"),
        )
        absent = events.filter(F.col("n_scored") == 0)
        low = events.filter((F.col("n_events") < 2 * min_events) & (F.col("n_scored") > 0))
        level = F.when(F.col("n_events") >= min_events, "WARN").otherwise("FAIL")
        rate = ratio(F.col("n_events"), F.col("n_scored"))
        parts += [
            _finding(absent, by, F.lit("FAIL"), "endpoint_missing", F.col("n_events")).select("*", bare),
            _finding(low, by, level, "event_count", F.col("n_events")).select("*", bare),
            _finding(
                events.filter(rate >= MAX_EVENT_RATE), by, F.lit("FAIL"), "event_rate", rate
            ).select("*", bare),
        ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def coverage_findings(
    matrix: DataFrame, signatures: DataFrame, by: str = "cohort_id", min_coverage: float = MIN_COVERAGE
) -> DataFrame:
    """Signature coverage and, where genes are present, samples missing one of them."""
    from cohortforge.operators.scoring import coverage

    cover = coverage(matrix, signatures, by)
    wanted = signatures.select("signature", "gene").distinct()
    complete = (
        matrix.filter(F.col("value").isNotNull())
        .select(by, "gene", "sample_id")
        .join(wanted, "gene")
        .groupBy(by, "signature", "sample_id")
        .agg(F.countDistinct("gene").alias("_k"))
        .join(cover.select(by, "signature", "n_found"), [by, "signature"])
        .filter(F.col("_k") == F.col("n_found"))
        .groupBy(by, "signature")
        .agg(F.count(F.lit(1)).alias("_complete"))
    )
    samples = matrix.groupBy(by).agg(F.countDistinct("sample_id").alias("_n"))
    found = cover.join(complete, [by, "signature"], "left").join(samples, by)
    incomplete = F.when(F.col("n_found") > 0, F.col("_n") - F.coalesce("_complete", F.lit(0)))
    return found.select(
        by,
        "signature",
        F.when(F.col("coverage") >= min_coverage, "INFO").otherwise("WARN").alias("level"),
        "coverage",
        F.slice("missing", 1, 20).alias("missing"),
        incomplete.alias("n_samples_incomplete"),
        F.when(incomplete > 0, "WARN").alias("incomplete_level"),
    )


def verdict(found: DataFrame, by: str = "cohort_id") -> DataFrame:
    """PASS when no finding of the cohort is a failure."""
    return found.groupBy(by).agg(
        F.bool_and(F.col("level") != "FAIL").alias("ok"),
        F.count_if(F.col("level") == "FAIL").alias("n_failures"),
        F.count_if(F.col("level") == "WARN").alias("n_warnings"),
    )


def raise_on_fail(found: DataFrame, by: str = "cohort_id") -> DataFrame:
    """Stop when any cohort has a failure, naming the first few; else pass through."""
    bad = found.filter(F.col("level") == "FAIL").select(by, "code").limit(10).collect()
    if bad:
        raise ValueError("quality failures: " + ", ".join(f"{b[0]}:{b[1]}" for b in bad))
    return found


def check_expectations(
    built: DataFrame, expected: DataFrame, by: str = "cohort_id"
) -> DataFrame:
    """Violations of pinned expectations (cohort, problem, expected, observed).

    ``built`` has (cohort, n_samples, n_genes, n_events).
    """
    s = built.alias("b").join(expected.alias("e"), by)
    delta = F.abs(F.col("b.n_samples") - F.col("e.n_samples"))
    row = lambda cond, name, want, got: F.when(
        cond, F.struct(F.lit(name).alias("problem"), want.cast("long").alias("expected"), got.cast("long").alias("observed"))
    )
    problems = F.array_compact(
        F.array(
            row(delta > F.col("e.n_samples_tolerance"), "n_samples", F.col("e.n_samples"), F.col("b.n_samples")),
            row(F.col("b.n_genes") < F.col("e.min_genes"), "n_genes", F.col("e.min_genes"), F.col("b.n_genes")),
            row(F.col("b.n_events") < F.col("e.min_events"), "n_events", F.col("e.min_events"), F.col("b.n_events")),
        )
    )
    return s.select(by, F.inline(problems))
