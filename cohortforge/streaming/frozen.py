"""Frozen-constant scoring of sample streams: stateless, append mode.

Input rows are (sample_id, expr map<string,double>) and the ``reference_id`` or ``model_id`` that the sample asks for: a
stream meets the stored constants by an equi-join on that id, whatever the number of models. Only frozen constants may
be applied to a stream; a cohort-relative score needs a closed population.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortforge.functions.numeric import finite, ratio
from cohortforge.operators.inference import PREDICTION_COLUMNS, block_percentile, rank_blocks


def _constants(scaler: DataFrame, key: str) -> DataFrame:
    """One row per model or reference with its genes, means and sds as parallel entries."""
    return scaler.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("gene", "mean", "sd"))).alias("_genes")
    )


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def score_stream(samples: DataFrame, reference: DataFrame, strict: bool = True) -> DataFrame:
    """Reference scores of a stream (or batch) of samples, each by the ``reference_id`` it carries.

    Strict mode flags samples lacking a fitted gene; otherwise the genes in
    common are averaged.  A missing value or spread contributes zero. An id without stored rowmean constants
    is ``unknown_reference``.
    """
    usable = reference.filter(F.col("scoring") == "rowmean")
    joined = samples.join(_constants(usable, "reference_id"), "reference_id", "left")
    present = F.filter("_genes", lambda g: F.map_contains_key("expr", g["gene"]))
    z = F.transform(
        "_present",
        lambda g: F.coalesce(ratio(F.col("expr")[g["gene"]] - g["mean"], g["sd"]), F.lit(0.0)),
    )
    code = (
        F.when(F.col("_genes").isNull(), "unknown_reference")
        .when(F.size("_present") == 0, "no_reference_genes")
        .when(F.lit(strict) & (F.size("_present") < F.size("_genes")), "missing_reference_genes")
        .otherwise("")
    )
    return (
        joined.withColumn("_present", present)
        .withColumn("error_code", code)
        .select(
            "sample_id",
            "reference_id",
            F.when(F.col("error_code") == "", ratio(_sum(z), F.size("_present"))).alias("score"),
            "error_code",
        )
    )


def predict_stream(samples: DataFrame, model: DataFrame, scaler: DataFrame, ranks: DataFrame) -> DataFrame:
    """Predictions of a stream with an ``error_code``; filter it for the two sinks.

    ``samples`` also carries ``expression_type`` and ``model_id``. Percentiles come from the stored ranks: a model's cut
    points name the block a score falls in, and the block's own entries settle it.
    """
    cuts, blocks = rank_blocks(ranks)
    constants = (
        model.join(_constants(scaler, "model_id"), "model_id").join(cuts, "model_id")
        .withColumnRenamed("expression_type", "_declared")
    )
    joined = samples.join(constants, "model_id", "left")
    value = lambda g: F.col("expr")[g["gene"]]
    z = F.transform("_genes", lambda g: (value(g) - g["mean"]) / g["sd"])
    scored = (
        joined.withColumn("_raw", _sum(z) / F.size("_genes"))
        .withColumn("score", (F.col("_raw") - F.col("composite_mean")) / F.col("composite_sd"))
        .withColumn("linear_predictor", F.col("score") * F.col("coefficient"))
        .withColumn("relative_hazard", F.exp("linear_predictor"))
        .withColumn("_block", F.try_element_at(F.filter("cuts", lambda c: c["first"] <= F.col("score")), F.lit(-1))["block"])
    )
    stored = blocks.select(F.col("model_id").alias("_owner"), F.col("block").alias("_stored"), "below", "entries")
    out = scored.join(stored, (F.col("model_id") == F.col("_owner")) & (F.col("_block") == F.col("_stored")), "left")
    percentile = block_percentile(F.col("score"), F.col("below"), F.col("entries"), F.col("n"))
    out = out.withColumn("training_percentile", F.when(F.col("_block").isNull(), 0.0).otherwise(percentile))
    missing = F.exists("_genes", lambda g: ~F.map_contains_key("expr", g["gene"]))
    broken = F.exists("_genes", lambda g: ~finite(value(g)))
    code = (
        F.when(F.col("_genes").isNull(), "MODEL_NOT_FOUND")
        .when(~F.col("expression_type").eqNullSafe(F.col("_declared")), "INCOMPATIBLE_EXPRESSION_TYPE")
        .when(missing, "MISSING_REQUIRED_GENES")
        .when(broken, "NONFINITE_EXPRESSION")
        .when(~finite(F.col("relative_hazard")), "INVALID_MATRIX")
        .otherwise("")
    )
    return out.withColumn("error_code", code).select(*PREDICTION_COLUMNS, "error_code")


def accepted(assessed: DataFrame) -> DataFrame:
    return assessed.filter(F.col("error_code") == "").select(*PREDICTION_COLUMNS)


def rejected(assessed: DataFrame) -> DataFrame:
    return assessed.filter(F.col("error_code") != "").select("sample_id", "model_id", "error_code")
