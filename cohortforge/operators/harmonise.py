"""Row-label harmonisation: probes to symbols, symbols to an approved authority,
and the explicit collapse of duplicate rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortforge.functions import text
from cohortforge.functions.staging import written

COLLAPSE_RULES = ("max_mean", "mean", "first")
MULTI_RULES = ("drop", "first")


def collapse_duplicates(
    matrix: DataFrame, rule: str = "max_mean", by: str = "cohort_id"
) -> DataFrame:
    """One row per (cohort, gene, sample), plus how many source rows the gene had.

    ``matrix`` has (cohort, gene, feature_pos, sample_id, value).  ``max_mean``
    keeps the source row with the highest mean (nulls skipped, all-null last,
    ties to the lowest ``feature_pos``); ``first`` keeps the lowest position;
    ``mean`` averages per sample.  Winners come from aggregates, not from a
    window over cells.
    """
    if rule not in COLLAPSE_RULES:
        raise ValueError(f"unknown collapse rule {rule!r}, choose from {COLLAPSE_RULES}")
    rows = matrix.groupBy(by, "gene", "feature_pos").agg(F.avg("value").alias("_mean"))
    lowest = F.lit(float("-inf"))
    ranking = F.struct(F.coalesce("_mean", lowest).alias("m"), (-F.col("feature_pos")).alias("p"))
    winners = rows.groupBy(by, "gene").agg(
        F.count(F.lit(1)).alias("n_rows_collapsed"),
        F.min("feature_pos").alias("_first"),
        (-F.max(ranking)["p"]).alias("_best"),
    )
    if rule == "mean":
        return (
            matrix.groupBy(by, "gene", "sample_id")
            .agg(F.avg("value").alias("value"))
            .join(written(winners.select(by, "gene", "n_rows_collapsed"), "collapse-counts"), [by, "gene"])
        )
    chosen = winners.select(
        by,
        "gene",
        F.col("_first" if rule == "first" else "_best").alias("feature_pos"),
        "n_rows_collapsed",
    )
    # Of known size: winners are broadcast while they are small, and the matrix is
    # then not shuffled at all.
    chosen = written(chosen, "collapse-winners")
    return matrix.join(chosen, [by, "gene", "feature_pos"]).select(
        by, "gene", "sample_id", "value", "n_rows_collapsed"
    )


def probe_map(annotation: DataFrame, multi: str = "drop", by: list[str] | None = None) -> DataFrame:
    """Classify probes as mapped, multi-target or unmapped from their symbol text."""
    if multi not in MULTI_RULES:
        raise ValueError(f"unknown multi-target rule {multi!r}, choose from {MULTI_RULES}")
    n = F.size("targets")
    usable = (n == 1) if multi == "drop" else (n >= 1)
    return (
        annotation.withColumn("probe", F.trim("probe"))
        .filter((F.col("probe") != "") & (F.lower("probe") != "nan"))
        .withColumn("targets", text.split_targets(F.col("symbol")))
        .select(
            *(by or []),
            "probe",
            "targets",
            F.when(usable, F.col("targets")[0]).alias("gene"),
            F.when(n == 0, "unmapped").when(n == 1, "mapped").otherwise("multi").alias("status"),
        )
    )


def label_probes(matrix: DataFrame, probes: DataFrame) -> DataFrame:
    """Attach the probe status; rows without a usable symbol keep a NULL gene.

    Where both tables name a ``platform``, a probe is looked up on its own platform.
    A probe that the annotation lists several times has the smallest of its symbols.
    """
    on = ["platform", "feature"] if {"platform"} <= {*matrix.columns} & {*probes.columns} else ["feature"]
    named = probes.withColumn("feature", F.trim("probe"))
    order = F.struct(F.col("gene").isNull().alias("none"), "gene", "status")
    lookup = named.groupBy(*on).agg(F.min(order).alias("_p")).select(*on, "_p.gene", "_p.status")
    return (
        matrix.withColumn("feature", F.trim("feature"))
        .join(written(lookup, "probes"), on, "left")
        .withColumn("status", F.coalesce("status", F.lit("unmapped")))
    )


def map_probes(
    matrix: DataFrame, probes: DataFrame, rule: str = "max_mean", by: str = "cohort_id"
) -> DataFrame:
    """Relabel a probe matrix with gene symbols and collapse duplicates."""
    mapped = label_probes(matrix, probes).filter(F.col("gene").isNotNull())
    return collapse_duplicates(
        mapped.select(by, "gene", "feature_pos", "sample_id", "value"), rule, by
    )


def probe_report(matrix: DataFrame, probes: DataFrame, by: str = "cohort_id") -> DataFrame:
    """Rows in, mapped, dropped as multi-target and dropped as unmapped, per cohort.

    A cohort with no mapped row is flagged: its matrix is from another platform.
    """
    named = [c for c in (by, "platform", "feature") if c in matrix.columns]
    rows = label_probes(matrix.select(*named).distinct(), probes)
    usable = F.col("gene").isNotNull()
    return (
        rows.groupBy(by)
        .agg(
            F.count(F.lit(1)).alias("n_rows_in"),
            F.count_if(usable).alias("n_mapped"),
            F.countDistinct("gene").alias("n_rows_out"),
            F.count_if((F.col("status") == "multi") & ~usable).alias("n_dropped_multi"),
            F.count_if(F.col("status") == "unmapped").alias("n_dropped_unmapped"),
        )
        .withColumn("no_match", F.col("n_mapped") == 0)
    )


def resolve_symbols(features: DataFrame, aliases: DataFrame, symbol: str = "feature") -> DataFrame:
    """Add the resolved ``gene`` and its ``resolution`` to a table of symbols.

    Exactly one approved symbol different from the listed one: remapped.  More
    than one: kept and reported as ambiguous, never guessed.  None: kept.
    """
    lookup = written(aliases.select(F.col("alias").alias("_alias"), "approved"), "aliases")
    listed = F.trim(F.col(symbol))
    joined = features.join(lookup, F.upper(listed) == F.col("_alias"), "left")
    single = (F.size("approved") == 1) & (F.col("approved")[0] != listed)
    remap = F.col("approved").isNotNull() & single
    several = F.col("approved").isNotNull() & (F.size("approved") > 1)
    return joined.select(
        *features.columns,
        F.when(remap, F.col("approved")[0]).otherwise(listed).alias("gene"),
        F.when(remap, "remapped").when(several, "ambiguous").otherwise("kept").alias("resolution"),
    )


def harmonise(
    matrix: DataFrame, aliases: DataFrame, rule: str = "max_mean", by: str = "cohort_id"
) -> DataFrame:
    """Resolve the row labels of a matrix and collapse the duplicates this creates."""
    resolved = resolve_symbols(matrix, aliases)
    return collapse_duplicates(
        resolved.select(by, "gene", "feature_pos", "sample_id", "value"), rule, by
    )


def symbol_report(features: DataFrame, aliases: DataFrame, by: str = "cohort_id") -> DataFrame:
    """Counts of what symbol resolution does, per cohort; features = (cohort, feature, feature_pos)."""
    resolved = resolve_symbols(features.select(by, "feature", "feature_pos").distinct(), aliases)
    sizes = resolved.groupBy(by, "gene").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(F.col("resolution") == "remapped").alias("_remapped"),
        F.count_if(F.col("resolution") == "ambiguous").alias("_ambiguous"),
    )
    return sizes.groupBy(by).agg(
        F.sum("_rows").alias("n_input"),
        F.count(F.lit(1)).alias("n_output"),
        F.sum("_remapped").alias("n_remapped"),
        F.sum("_ambiguous").alias("n_ambiguous"),
        F.count_if(F.col("_rows") > 1).alias("n_collapsed"),
    )


def outdated_signature_genes(signatures: DataFrame, aliases: DataFrame) -> DataFrame:
    """Signature genes the authority has renamed; reported, never rewritten."""
    resolved = resolve_symbols(
        signatures.select("signature", F.col("gene").alias("listed")), aliases, "listed"
    )
    return resolved.filter(F.col("resolution") == "remapped").select(
        "signature", "listed", F.col("gene").alias("approved")
    )


# Aliquots and patients ------------------------------------------------------


def parse_barcodes(df: DataFrame, barcode: str = "barcode") -> DataFrame:
    """Add ``patient`` and ``sample_type``; both NULL where the barcode is malformed."""
    return df.withColumn("patient", text.barcode_patient(F.col(barcode))).withColumn(
        "sample_type", text.barcode_type(F.col(barcode))
    )


def is_primary() -> Column:
    """Primary tumour: declared type 01, or a barcode that carries no type."""
    return F.col("patient").isNotNull() & (
        F.col("sample_type").isNull() | (F.col("sample_type") == text.PRIMARY_TYPE)
    )


def primary_samples(parsed: DataFrame) -> DataFrame:
    return parsed.filter(is_primary())


def non_primary_samples(parsed: DataFrame) -> DataFrame:
    """The complement: other sample types and unparseable barcodes."""
    return parsed.filter(~F.coalesce(is_primary(), F.lit(False)))


def to_patients(
    cells: DataFrame, rule: str = "first", keys: list[str] | None = None, by: str = "cohort_id"
) -> DataFrame:
    """Resolve several aliquots of a patient.

    ``cells`` has (keys, patient, barcode, value).  ``first`` keeps the lowest
    barcode of each patient; ``mean`` averages the aliquots.  A patient of two cohorts
    (``by``, where the cells name it) is resolved in each of them.
    """
    extra = keys or []
    cohort = [by] if by in cells.columns else []
    if rule == "mean":
        return cells.groupBy(*extra, "patient").agg(
            F.avg("value").alias("value"), F.countDistinct("barcode").alias("n_aliquots")
        )
    if rule != "first":
        raise ValueError(f"unknown aliquot rule {rule!r}")
    chosen = cells.groupBy(*cohort, "patient").agg(F.min("barcode").alias("barcode"))
    return cells.join(chosen, [*cohort, "patient", "barcode"])


def duplicated_patients(aliquots: DataFrame) -> DataFrame:
    """Patients with more than one aliquot, so the choice is reported."""
    return (
        aliquots.select("patient", "barcode").distinct().groupBy("patient")
        .agg(F.count(F.lit(1)).alias("n_aliquots"))
        .filter(F.col("n_aliquots") > 1)
    )
