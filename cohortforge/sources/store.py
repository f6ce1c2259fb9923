"""Cohort, reference and model stores: plain Parquet tables with content hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortforge.functions.hashing import content_checksum, population_hash, rows_checksum, tagged_sha
from cohortforge.functions.staging import written
from cohortforge.operators.inference import PREDICTION_COLUMNS, ranked_scores
from cohortforge.operators.ordering import spread_totals

MATRIX_COLUMNS = ["gene", "sample_id", "value"]


def _identity(matrix: DataFrame) -> DataFrame:
    sums = content_checksum(matrix, ["cohort_id"], MATRIX_COLUMNS)
    shape = matrix.groupBy("cohort_id").agg(F.countDistinct("gene").alias("n_genes"))
    people = population_hash(matrix, ["cohort_id"])
    return sums.join(shape, "cohort_id").join(people, "cohort_id")


def save_cohorts(matrix: DataFrame, clinical: DataFrame, path: str) -> None:
    """Write expression (by cohort, sorted by gene), clinical and identity tables."""
    columns = ["cohort_id", *MATRIX_COLUMNS]
    (
        matrix.select(*columns)
        .repartition("cohort_id", "gene")
        .sortWithinPartitions("cohort_id", "gene")
        .write.partitionBy("cohort_id").parquet(f"{path}/expression")
    )
    clinical.write.partitionBy("cohort_id").parquet(f"{path}/clinical")
    stored = matrix.sparkSession.read.schema(matrix.select(*columns).schema).parquet(f"{path}/expression")
    _identity(stored).write.parquet(f"{path}/identity")


def verify_cohorts(spark: SparkSession, path: str) -> DataFrame:
    """Stored against recomputed identity: (cohort, status) with ok, changed or missing."""
    recorded = spark.read.parquet(f"{path}/identity").select(
        "cohort_id", F.col("content_checksum").alias("_want"), F.col("population_hash").alias("_people")
    )
    now = _identity(_expression(spark, path)).select("cohort_id", "content_checksum", "population_hash")
    status = (
        F.when(F.col("content_checksum").isNull(), "missing")
        .when(
            (F.col("content_checksum") == F.col("_want")) & (F.col("population_hash") == F.col("_people")), "ok"
        )
        .otherwise("changed")
    )
    return recorded.join(now, "cohort_id", "left").select("cohort_id", status.alias("status"))


def _expression(spark: SparkSession, path: str) -> DataFrame:
    schema = "gene string, sample_id string, value double, cohort_id string"
    return spark.read.schema(schema).parquet(f"{path}/expression").select("cohort_id", *MATRIX_COLUMNS)


def load_cohorts(spark: SparkSession, path: str, verify: bool = True) -> tuple[DataFrame, DataFrame]:
    """(matrix, clinical); refuses a store whose content no longer matches its identity."""
    if verify:
        bad = verify_cohorts(spark, path).filter(F.col("status") != "ok").limit(5).collect()
        if bad:
            raise ValueError("store changed since it was written: " + ", ".join(b["cohort_id"] for b in bad))
    return _expression(spark, path), spark.read.parquet(f"{path}/clinical")


# Scaler and reference registry ----------------------------------------------------


def save_references(reference: DataFrame, path: str) -> None:
    """Append reference rows and one checksum row per reference.

    Only the new rows are summed, so a later append never vouches for stored ones. An id
    that is there already is an error: a reference is frozen once.
    """
    spark = reference.sparkSession
    sums = written(_reference_sums(reference), "reference-sums")
    sums.limit(0).write.mode("append").parquet(f"{path}/checksums")
    known = spark.read.schema(sums.schema).parquet(f"{path}/checksums")
    again = known.join(sums.select("reference_id"), "reference_id", "left_semi").limit(5).collect()
    if again:
        raise ValueError("reference exists: " + ", ".join(r["reference_id"] for r in again))
    reference.write.mode("append").parquet(f"{path}/rows")
    sums.write.mode("append").parquet(f"{path}/checksums")


def _reference_sums(reference: DataFrame) -> DataFrame:
    return rows_checksum(reference, ["reference_id"], "gene", ["gene", "mean", "sd"], "checksum")


def load_references(spark: SparkSession, path: str, reference_ids: list[str] | None = None) -> DataFrame:
    """Reference rows by id; an unknown id or a changed constant is an error."""
    rows = spark.read.parquet(f"{path}/rows")
    sums = spark.read.parquet(f"{path}/checksums")
    if reference_ids is not None:
        rows = rows.filter(F.col("reference_id").isin(reference_ids))
        known = {r["reference_id"] for r in sums.filter(F.col("reference_id").isin(reference_ids)).select("reference_id").collect()}
        unknown = sorted(set(reference_ids) - known)
        if unknown:
            raise ValueError(f"no such reference: {unknown}")
        sums = sums.filter(F.col("reference_id").isin(reference_ids))
    now = _reference_sums(rows).withColumnRenamed("checksum", "_now")
    drift = sums.join(now, "reference_id", "left").filter(~F.col("checksum").eqNullSafe(F.col("_now")))
    bad = drift.limit(5).collect()
    if bad:
        raise ValueError("reference constants changed: " + ", ".join(b["reference_id"] for b in bad))
    return rows


def list_references(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(f"{path}/rows")
    sums = spark.read.parquet(f"{path}/checksums")
    return rows.groupBy("reference_id").agg(
        F.count(F.lit(1)).alias("n_genes"),
        F.max("n_fit").alias("n_train"),
        F.first("population_hash").alias("population_hash"),
    ).join(sums, "reference_id")


# Model store ------------------------------------------------------------------------


def freeze_model(
    model_id: str,
    version: str,
    expression_type: str,
    scored: DataFrame,
    scaler: DataFrame,
    coefficient: DataFrame,
    key: list[str],
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Model, scaler and ranked training scores of one full-cohort fit.

    ``scored`` has (key, raw, score, composite_mean, composite_sd) of the
    training samples, ``coefficient`` (key, beta).  The scores are rows
    (``RANKS_SCHEMA``), whatever their number.
    """
    constants = scored.groupBy(*key).agg(
        F.first("composite_mean").alias("composite_mean"), F.first("composite_sd").alias("composite_sd")
    )
    model = constants.join(coefficient, key).select(
        F.lit(model_id).alias("model_id"),
        F.lit(version).alias("model_version"),
        F.lit(expression_type).alias("expression_type"),
        F.col("beta")[0].alias("coefficient"),
        "composite_mean",
        "composite_sd",
    )
    ranks = ranked_scores(scored.select(F.lit(model_id).alias("model_id"), "score"), ["model_id"])
    return model, scaler.select(F.lit(model_id).alias("model_id"), "gene", "mean", "sd"), ranks


def _model_sums(model: DataFrame, scaler: DataFrame, ranks: DataFrame) -> DataFrame:
    """Checksums of each model's constants, scaler and ranked scores; those of the scores are sums, so no list is built."""
    constants = rows_checksum(scaler, ["model_id"], "gene", ["gene", "mean", "sd"], "scaler_checksum")
    body = model.select(
        "model_id",
        tagged_sha(
            F.concat_ws(
                "|", "model_version", "expression_type",
                F.format_string("%.12f", "coefficient"), F.format_string("%.12f", "composite_mean"),
                F.format_string("%.12f", "composite_sd"),
            )
        ).alias("model_checksum"),
    )
    one = F.xxhash64(F.format_string("%.10f", "score"), "count", "cum_count", "n")
    scores = ranks.groupBy("model_id").agg(
        F.concat_ws(":", F.count(F.lit(1)), F.sum(one.cast("decimal(38,0)")), F.bit_xor(one)).alias("ranks_checksum")
    )
    return body.join(constants, "model_id", "full_outer").join(scores, "model_id", "full_outer")


def save_models(model: DataFrame, scaler: DataFrame, ranks: DataFrame, path: str) -> None:
    model.write.parquet(f"{path}/model")
    scaler.write.parquet(f"{path}/scaler")
    ranks.write.parquet(f"{path}/ranks")
    _model_sums(model, scaler, ranks).write.parquet(f"{path}/checksums")


def model_invariants(spark: SparkSession, path: str) -> DataFrame:
    """One row per model with the first broken invariant, or none."""
    model, scaler, ranks = (spark.read.parquet(f"{path}/{part}") for part in ("model", "scaler", "ranks"))
    recorded = spark.read.parquet(f"{path}/checksums").select(
        "model_id", F.col("model_checksum").alias("_m"), F.col("scaler_checksum").alias("_s"), F.col("ranks_checksum").alias("_r")
    )
    return _broken(recorded, model, scaler, ranks)


def _broken(recorded: DataFrame, model: DataFrame, scaler: DataFrame, ranks: DataFrame) -> DataFrame:
    """``model_id, error_code`` of every recorded model; ``recorded`` has the checksums ``_m, _s, _r``."""
    genes = scaler.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.countDistinct("gene").alias("_genes"),
        F.count_if(~F.coalesce(F.col("sd") > 0, F.lit(False)) | F.col("mean").isNull()).alias("_bad"),
    )
    renamed = ranks.withColumnsRenamed({"cum_count": "recorded_cum_count", "n": "recorded_n"})
    placed = spread_totals(renamed, ["model_id"], ["score"], ["count"])
    order = placed.groupBy("model_id").agg(
        F.count_if(F.col("cum_count") != F.col("recorded_cum_count")).alias("_misplaced"),
        (F.max("cum_count") == F.max("recorded_n")).alias("_whole"),
    )
    joined = recorded.join(_model_sums(model, scaler, ranks), "model_id", "left").join(
        model, "model_id", "left"
    ).join(genes, "model_id", "left").join(order, "model_id", "left")
    code = (
        F.when(F.col("coefficient").isNull() | F.col("_rows").isNull() | F.col("_misplaced").isNull(), "missing_part")
        .when(~F.col("model_checksum").eqNullSafe(F.col("_m")), "model_checksum_mismatch")
        .when(~F.col("scaler_checksum").eqNullSafe(F.col("_s")), "scaler_checksum_mismatch")
        .when(~F.col("ranks_checksum").eqNullSafe(F.col("_r")), "ranks_checksum_mismatch")
        .when(F.col("_rows") != F.col("_genes"), "duplicate_scaler_gene")
        .when(F.col("_bad") > 0, "scaler_not_positive")
        .when(~(F.col("composite_sd") > 0), "composite_not_positive")
        .when((F.col("_misplaced") > 0) | ~F.col("_whole"), "ranks_not_in_order")
        .otherwise("")
    )
    return joined.select("model_id", code.alias("error_code"))


def load_models(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    bad = model_invariants(spark, path).filter(F.col("error_code") != "").limit(5).collect()
    if bad:
        raise ValueError("model refused: " + ", ".join(f"{b['model_id']}:{b['error_code']}" for b in bad))
    return tuple(spark.read.parquet(f"{path}/{part}") for part in ("model", "scaler", "ranks"))


def read_bundles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """JSON model bundles (one directory each) as model, scaler and ranked score rows.

    Reads ``model.json``, ``scaler.json``, ``features.json`` and
    ``training.json`` of every bundle directory below ``path``.
    """

    def part(name: str, schema: str) -> DataFrame:
        return (
            spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True)
            .option("pathGlobFilter", name).json(path)
            .withColumn("_dir", F.regexp_replace("_metadata.file_path", "/[^/]*$", ""))
        )

    model = part("model.json", "model_id string, version string, coefficient double")
    constants = part(
        "scaler.json",
        "composite_mean double, composite_sample_sd double, gene_means map<string,double>, "
        "gene_sample_sds map<string,double>, genes array<string>",
    )
    features = part("features.json", "expression_type string")
    training = part("training.json", "score_reference_sorted array<double>")
    rows = model.join(constants, "_dir").join(features, "_dir")
    models = rows.select(
        "model_id",
        F.col("version").alias("model_version"),
        "expression_type",
        "coefficient",
        "composite_mean",
        F.col("composite_sample_sd").alias("composite_sd"),
    )
    scaler = rows.select("model_id", F.explode("genes").alias("gene"), "gene_means", "gene_sample_sds").select(
        "model_id", "gene", F.col("gene_means")[F.col("gene")].alias("mean"), F.col("gene_sample_sds")[F.col("gene")].alias("sd")
    )
    scores = model.join(training, "_dir").select("model_id", F.explode("score_reference_sorted").alias("score"))
    return models, scaler, ranked_scores(scores, ["model_id"])


def bundle_problems(spark: SparkSession, path: str) -> DataFrame:
    """``dir, problem`` of every bundle directory that can't be used; the first that holds.

    Files by their manifest (``file_missing``, ``file_changed``, ``file_unlisted``), then the content: ``coefficient_missing``,
    ``gene_without_constants``, ``scaler_not_positive``, ``composite_not_positive``, ``scores_missing``, ``scores_not_sorted``.
    """
    files = bundle_file_status(spark, path).filter(F.col("status") != "ok")
    order = F.create_map(F.lit("missing"), F.lit(0), F.lit("changed"), F.lit(1), F.lit("unlisted"), F.lit(2))
    broken = files.groupBy("dir").agg(F.min_by("status", order[F.col("status")]).alias("_file"))

    def part(name: str, schema: str) -> DataFrame:
        read = (
            spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True)
            .option("pathGlobFilter", name).json(path)
        )
        folder = F.regexp_replace(F.regexp_replace("_metadata.file_path", "/[^/]*$", ""), "^file:/+", "/")
        return read.withColumn("dir", folder)

    model = part("model.json", "coefficient double")
    constants = part(
        "scaler.json",
        "composite_mean double, composite_sample_sd double, gene_means map<string,double>, "
        "gene_sample_sds map<string,double>, genes array<string>",
    )
    scores = F.col("score_reference_sorted")
    training = part("training.json", "score_reference_sorted array<double>").select(
        "dir", (F.coalesce(F.size(scores), F.lit(0)) > 0).alias("_scores"), (scores == F.array_sort(scores)).alias("_sorted")
    )
    lacking = F.exists("genes", lambda g: F.col("gene_means")[g].isNull() | F.col("gene_sample_sds")[g].isNull())
    flat = F.exists("genes", lambda g: ~(F.col("gene_sample_sds")[g] > 0))
    joined = model.join(constants, "dir", "full_outer").join(training, "dir", "full_outer").join(broken, "dir", "full_outer")
    problem = (
        F.when(F.col("_file").isNotNull(), F.concat(F.lit("file_"), F.col("_file")))
        .when(F.col("coefficient").isNull(), "coefficient_missing")
        .when(F.coalesce(lacking, F.lit(True)), "gene_without_constants")
        .when(flat, "scaler_not_positive")
        .when(~F.coalesce(F.col("composite_sample_sd") > 0, F.lit(False)), "composite_not_positive")
        .when(~F.coalesce("_scores", F.lit(False)), "scores_missing")
        .when(~F.coalesce("_sorted", F.lit(False)), "scores_not_sorted")
    )
    return joined.select("dir", problem.alias("problem")).filter(F.col("problem").isNotNull())


def bundle_file_status(spark: SparkSession, path: str) -> DataFrame:
    """Every file a bundle manifest lists, with ok, changed or missing; unlisted files too."""
    manifests = (
        spark.read.schema("model_id string, files map<string,string>").option("multiLine", True)
        .option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.json").json(path)
        .select(
            F.regexp_replace(F.regexp_replace("_metadata.file_path", "/[^/]*$", ""), "^file:/+", "/").alias("dir"),
            "model_id", F.explode("files").alias("name", "recorded"),
        )
    )
    clean = F.regexp_replace("path", "^file:/+", "/")
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path)
        .select(
            F.regexp_replace(clean, "/[^/]*$", "").alias("dir"),
            F.element_at(F.split(clean, "/"), -1).alias("name"),
            tagged_sha(F.col("content")).alias("observed"),
        )
        .filter(F.col("name") != "manifest.json")
    )
    status = (
        F.when(F.col("observed").isNull(), "missing").when(F.col("recorded").isNull(), "unlisted")
        .when(F.col("observed") == F.col("recorded"), "ok").otherwise("changed")
    )
    return manifests.join(found, ["dir", "name"], "full_outer").select("dir", "name", status.alias("status"))


# Sinks --------------------------------------------------------------------------------


def write_predictions(predictions: DataFrame, path: str, output_format: str = "json") -> None:
    """Predictions in the stable seven-column schema, as JSON lines or TSV."""
    table = predictions.select(*PREDICTION_COLUMNS)
    if output_format == "json":
        table.write.json(path)
    elif output_format == "tsv":
        table.write.csv(path, sep="\t", header=True)
    else:
        raise ValueError("format must be json or tsv")


def export_tables(tables: dict[str, DataFrame], path: str) -> None:
    """One Parquet table per cross-validation result."""
    for name, table in tables.items():
        table.write.parquet(f"{path}/{name}")
