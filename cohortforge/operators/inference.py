"""Frozen-model prediction: constants in, risk and percentile out, rejects by code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortforge.functions.numeric import finite
from cohortforge.functions.staging import written
from cohortforge.operators.ordering import spread_totals

# Public output columns and per-request error codes.
PREDICTION_COLUMNS = [
    "sample_id",
    "score",
    "linear_predictor",
    "relative_hazard",
    "training_percentile",
    "model_id",
    "model_version",
]
ERROR_CODES = [
    "INCOMPATIBLE_EXPRESSION_TYPE",
    "MISSING_REQUIRED_GENES",
    "DUPLICATE_REQUIRED_GENES",
    "NONFINITE_EXPRESSION",
    "DUPLICATE_SAMPLE_IDS",
    "INVALID_MATRIX",
    "REQUEST_TOO_LARGE",
    "MODEL_NOT_FOUND",
]

MODEL_SCHEMA = (
    "model_id string, model_version string, expression_type string, coefficient double, "
    "composite_mean double, composite_sd double"
)
RANKS_SCHEMA = "model_id string, score double, count long, cum_count long, n long"


def ranked_scores(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Training scores (keys, score) as a ranked table: one row per distinct score.

    Adds ``count`` (scores equal to it), ``cum_count`` (scores up to it) and ``n`` (all of its key).
    """
    points = scores.filter(F.col("score").isNotNull()).groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("count"))
    points = written(points, "score-points")
    placed = spread_totals(points, keys, ["score"], ["count"])
    sizes = points.groupBy(*keys).agg(F.sum("count").alias("n"))
    return placed.select(*keys, "score", "count", F.col("cum_count").cast("long").alias("cum_count")).join(sizes, keys)


def rank_percentiles(scores: DataFrame, ranks: DataFrame, keys: list[str]) -> DataFrame:
    """Training percentile of (keys, sample_id, score): percent of a key's training scores that are at most ``score``.

    ``ranks`` is a ranked table. Both are counted per distinct value, and one running total covers them.
    """
    asked = scores.select(*keys, "score").distinct().withColumn("_c", F.lit(0).cast("long"))
    cells = ranks.select(*keys, "score", F.col("count").alias("_c")).unionByName(asked)
    cells = cells.groupBy(*keys, "score").agg(F.sum("_c").alias("_c"))
    placed = spread_totals(cells, keys, ["score"], ["_c"]).select(*keys, "score", "cum__c")
    sizes = ranks.groupBy(*keys).agg(F.max("n").alias("_n"))
    return scores.join(placed, [*keys, "score"]).join(sizes, keys).withColumn(
        "training_percentile", F.lit(100.0) * F.col("cum__c") / F.col("_n")
    ).drop("cum__c", "_n")


def rank_blocks(ranks: DataFrame, key: str = "model_id") -> tuple[DataFrame, DataFrame]:
    """A ranked table as ``cuts`` and ``blocks``, for lookups without a shuffle of what is looked up.

    A block holds about as many scores as its key has blocks, the root of their number, so neither list of a key grows
    faster. ``cuts`` has a row per key: ``n`` and the ``cuts`` (first score, block); ``blocks`` a row per block: its ``entries``
    (score, cum_count) and what comes ``below`` it.
    """
    width = F.ceil(F.sqrt(F.col("n").cast("double")))
    placed = ranks.withColumn("block", F.floor((F.col("cum_count") - F.col("count")) / width).cast("long"))
    blocks = written(
        placed.groupBy(key, "block").agg(
            F.min("score").alias("first"),
            F.min(F.col("cum_count") - F.col("count")).alias("below"),
            F.array_sort(F.collect_list(F.struct("score", "cum_count"))).alias("entries"),
            F.max("n").alias("n"),
        ),
        "rank-blocks",
    )
    cuts = blocks.groupBy(key).agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("first", "block"))).alias("cuts")
    )
    return written(cuts, "rank-cuts"), blocks.select(key, "block", "below", "entries")


def block_percentile(score: Column, below: Column, entries: Column, n: Column) -> Column:
    """Percent of the training scores up to ``score``, from the block it falls in (null block: below them all)."""
    upto = F.filter(entries, lambda e: e["score"] <= score)
    inside = F.try_element_at(upto, F.lit(-1))["cum_count"]
    return F.lit(100.0) * F.when(F.size(upto) > 0, inside).otherwise(F.coalesce(below, F.lit(0))) / n


def assess(
    matrix: DataFrame,
    model: DataFrame,
    scaler: DataFrame,
    ranks: DataFrame,
    requests: DataFrame | None = None,
    max_genes: int | None = None,
    max_samples: int | None = None,
) -> DataFrame:
    """Every requested (batch, model, sample) with its prediction or its error code.

    ``matrix`` has (sample_id, gene, value, expression_type) and, where it holds several
    requests, ``batch_id``; ``requests`` (batch_id, model_id) then says which model each
    of them asks for.  Without requests there is one batch, which asks for every model.
    A ``sample_pos`` column tells columns of a batch apart, so that equal sample ids are
    found.  ``model`` follows ``MODEL_SCHEMA``, ``ranks`` ``RANKS_SCHEMA``; ``scaler`` has (model_id, gene, mean, sd).
    Genes beyond the model's are ignored; a missing or non-finite one refuses the sample.
    ``max_genes`` and ``max_samples`` are limits of a request, none by default.
    """
    if "batch_id" not in matrix.columns:
        if requests is not None:
            raise ValueError("requests need a matrix with batch_id")
        matrix = matrix.withColumn("batch_id", F.lit(""))
        requests = model.select(F.lit("").alias("batch_id"), "model_id")
    elif requests is None:
        raise ValueError("a matrix with batch_id needs requests")
    samples = matrix.groupBy("batch_id", "sample_id").agg(
        F.min("expression_type").alias("_type"),
        F.max("expression_type").alias("_type_max"),
        F.count_if(F.col("expression_type").isNull()).alias("_untyped"),
    )
    genes = scaler.groupBy("model_id").agg(F.countDistinct("gene").alias("_n_genes"))
    constants = model.join(genes, "model_id")
    refused = _batch_refusals(matrix, max_genes, max_samples)
    every = samples.join(requests, "batch_id").join(constants, "model_id", "left").join(refused, "batch_id", "left")
    value = F.col("value").try_cast("double")
    cells = (
        matrix.select("batch_id", "sample_id", "gene", value.alias("value"))
        .join(requests, "batch_id")
        .join(scaler.select("model_id", "gene", "mean", "sd"), ["model_id", "gene"])
        .groupBy("batch_id", "model_id", "sample_id")
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.size(F.collect_set("gene")).alias("_present"),
            F.count_if(finite(F.col("value"))).alias("_finite"),
            F.sum((F.col("value") - F.col("mean")) / F.col("sd")).alias("_sum"),
        )
    )
    joined = every.join(cells, ["batch_id", "model_id", "sample_id"], "left")
    raw = F.col("_sum") / F.col("_n_genes")
    out = (
        joined.withColumn("score", (raw - F.col("composite_mean")) / F.col("composite_sd"))
        .withColumn("linear_predictor", F.col("score") * F.col("coefficient"))
        .withColumn("relative_hazard", F.exp("linear_predictor"))
    )
    typed = (
        (F.col("_untyped") == 0)
        & (F.col("_type") == F.col("expression_type"))
        & (F.col("_type_max") == F.col("expression_type"))
    )
    present = F.coalesce("_present", F.lit(0))
    code = (
        F.when(F.col("_n_genes").isNull(), "MODEL_NOT_FOUND")
        .when(F.col("_refused").isNotNull(), F.col("_refused"))
        .when(~F.coalesce(typed, F.lit(False)), "INCOMPATIBLE_EXPRESSION_TYPE")
        .when(F.col("_rows") > present, "DUPLICATE_REQUIRED_GENES")
        .when(present < F.col("_n_genes"), "MISSING_REQUIRED_GENES")
        .when(F.col("_finite") < F.col("_rows"), "NONFINITE_EXPRESSION")
        .when(~F.coalesce(finite(F.col("relative_hazard")), F.lit(False)), "INVALID_MATRIX")
        .otherwise("")
    )
    scored = written(out.withColumn("error_code", code), "assessed")
    good = scored.filter(F.col("error_code") == "")
    ranked = rank_percentiles(good.select("model_id", "batch_id", "sample_id", "score"), ranks, ["model_id"])
    ranked = ranked.select("model_id", "batch_id", "sample_id", "training_percentile")
    return scored.join(ranked, ["model_id", "batch_id", "sample_id"], "left").select(
        "batch_id", *PREDICTION_COLUMNS, "error_code"
    )


def _batch_refusals(matrix: DataFrame, max_genes: int | None, max_samples: int | None) -> DataFrame:
    """(batch_id, _refused) of batches refused as a whole: too large, or equal sample ids."""
    place = [c for c in ("sample_id", "sample_pos") if c in matrix.columns]
    shape = matrix.groupBy("batch_id").agg(
        F.countDistinct("gene").alias("_g"), F.countDistinct("sample_id").alias("_s"), F.countDistinct(*place).alias("_p")
    )
    large = F.lit(False)
    for count, most in (("_g", max_genes), ("_p", max_samples)):
        large = large | (F.col(count) > F.lit(most) if most is not None else F.lit(False))
    code = F.when(large, "REQUEST_TOO_LARGE").when(F.col("_p") > F.col("_s"), "DUPLICATE_SAMPLE_IDS")
    return shape.select("batch_id", code.alias("_refused"))


def predictions(assessed: DataFrame) -> DataFrame:
    """Accepted samples in the stable public schema."""
    return assessed.filter(F.col("error_code") == "").select(*PREDICTION_COLUMNS)


def rejects(assessed: DataFrame) -> DataFrame:
    return assessed.filter(F.col("error_code") != "").select("sample_id", "model_id", "error_code")


def matrix_problems(cells: DataFrame, required: DataFrame, by: str = "batch_id") -> DataFrame:
    """Request-shape problems per batch: duplicates, ragged rows, transposition.

    ``cells`` has (batch, gene, sample_id, value) with one row per listed cell;
    ``required`` lists the genes a model needs.
    """
    shape = cells.groupBy(by).agg(
        F.countDistinct("gene").alias("_g"),
        F.countDistinct("sample_id").alias("_s"),
        F.countDistinct("gene", "sample_id").alias("_d"),
        F.count(F.lit(1)).alias("_n"),
    )
    genes = required.select("gene").distinct()
    as_gene = cells.join(genes, "gene", "left_semi").select(by).distinct()
    as_sample = (
        cells.join(genes.select(F.col("gene").alias("sample_id")), "sample_id", "left_semi")
        .select(by).distinct().withColumn("_t", F.lit(True))
    )
    flagged = shape.join(as_gene.withColumn("_ok", F.lit(True)), by, "left").join(as_sample, by, "left")
    code = (
        F.when(F.col("_n") > F.col("_d"), "duplicate_cells")
        .when(F.col("_t").isNotNull() & F.col("_ok").isNull(), "transposed")
        .when(F.col("_d") != F.col("_g") * F.col("_s"), "ragged")
    )
    return flagged.withColumn("problem", code).filter(F.col("problem").isNotNull()).select(by, "problem")
