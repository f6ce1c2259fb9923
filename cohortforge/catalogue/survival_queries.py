"""Registered queries: frozen statistics, folds, concordance, Cox fits, resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortforge.catalogue import survival_sql as S
from cohortforge.catalogue.base_sql import X1, X2, X6, r
from cohortforge.catalogue.endpoint_queries import derived
from cohortforge.functions.hashing import population_hash
from cohortforge.functions.numeric import round_at
from cohortforge.functions.staging import literal_rows, written
from cohortforge.operators import cox, crossval, endpoints, folds, inference, resample, scaler, scoring
from cohortforge.plans import standins
from cohortforge.sources import store

OUTER, INNER, REPEATS = 5, 5, 5
CV_GENES = [f"Brand#{i}" for i in range(1, 21)]
DRAWS = 2000
PERMUTATIONS = 5
FINAL_FOLDS = 3
NET_GRID = [(4 * k + n, a, r) for k, r in enumerate((0.9, 0.5, 0.1)) for n, a in enumerate((0.1, 0.05, 0.02, 0.01))]
# Candidate composites over growing parts of the signature.
CANDIDATES = [(k, g) for k, n in enumerate((5, 12, 20)) for g in CV_GENES[:n]]


def _rounded(df: DataFrame, keep: list[str], measures: list[str]) -> DataFrame:
    return df.select(*keep, *[round_at(F.col(c)).alias(c) for c in measures])


# Frozen statistics ---------------------------------------------------------------


def _s20(spark: SparkSession) -> DataFrame:
    return standins.signatures(spark).filter(F.col("signature") == "s20")


def _halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 signature cells with the digest half of each sample."""
    even = F.conv(F.substring(F.md5("sample_id"), 1, 1), 16, 10).cast("int") % 2 == 0
    return standins.expression(spark, sf_dir, standins.signature_genes("s20")).withColumn("train", even)


def scaler_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scaler.fit(_halves(spark, sf_dir).filter("train"), ["cohort_id"])
    return _rounded(out.withColumnRenamed("cohort_id", "scaler_id"), ["scaler_id", "gene", "n_fit"], ["mean", "sd"])


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = _halves(spark, sf_dir).filter("train")
    return scaler.build_reference(train, _s20(spark), population_hash(train, ["cohort_id"]))


def reference_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out halves against the reference of every segment, on the genes in common."""
    reference = written(_references(spark, sf_dir), "references")
    test = _halves(spark, sf_dir).filter("NOT train")
    out = scaler.score_reference(test, reference, strict=False)
    return _rounded(out, ["cohort_id", "reference_id", "sample_id", "n_present"], ["score"])


def reference_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _references(spark, sf_dir).groupBy("reference_id", "population_hash").agg(
        F.count(F.lit(1)).alias("n_genes"), F.max("n_fit").alias("n_train")
    )


def leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cross-validation path with held-out values moved, and a control that fits on them."""
    cells = written(_halves(spark, sf_dir), "halves")
    role = F.when(F.col("train"), "train").otherwise("test")
    roles = written(cells.select("cohort_id", "sample_id", role.alias("role")).distinct(), "half-roles")
    matrix = cells.select("cohort_id", "gene", "sample_id", "value")
    honest = crossval.leakage(matrix, roles, ["cohort_id"])
    control = crossval.leakage(matrix, roles, ["cohort_id"], fit_on=("train", "test"))
    return honest.join(control.select("cohort_id", F.col("unchanged").alias("_control")), "cohort_id").select(
        "cohort_id", "n_train", F.col("unchanged").cast("int").alias("unchanged"), F.col("_control").cast("int").alias("control_unchanged")
    )


# Frozen-model inference ------------------------------------------------------------

MODEL_GENES = [f"d{i:02d}" for i in range(20)]


def _model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A 20-feature model frozen on all vectors; the coefficient is a literal."""
    train = standins.dense_expression(spark, sf_dir).filter(F.col("gene").isin(MODEL_GENES))
    fitted = written(scaler.fit(train, ["cohort_id"]), "model-scaler")
    z = scaler.transform(train, fitted, ["cohort_id"]).groupBy("cohort_id", "sample_id").agg(F.avg("z").alias("raw"))
    z = written(z, "model-composite")
    spread = z.groupBy("cohort_id").agg(
        F.avg("raw").alias("composite_mean"), F.stddev_samp("raw").alias("composite_sd")
    )
    scored = z.join(spread, "cohort_id").withColumn(
        "score", (F.col("raw") - F.col("composite_mean")) / F.col("composite_sd")
    )
    coefficient = z.select("cohort_id").distinct().withColumn("beta", F.array(F.lit(0.58)))
    return store.freeze_model("dense20", "1.0.0", "dense", scored, fitted, coefficient, ["cohort_id"])


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense cells as prediction requests, with one defect per vector class."""
    cells = standins.dense_expression(spark, sf_dir)
    k = F.col("sample_id").cast("long") % 11
    kept = cells.filter(~((k == 3) & (F.col("gene") == "d05")))
    broken = kept.withColumn(
        "value", F.when((k == 4) & (F.col("gene") == "d07"), F.lit(float("nan"))).otherwise(F.col("value"))
    ).withColumn("expression_type", F.when(k == 5, F.lit("counts")).otherwise(F.lit("dense")))
    twice = broken.filter((k == 6) & (F.col("gene") == "d01"))
    return broken.unionByName(twice)


def frozen_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = inference.predictions(inference.assess(_requests(spark, sf_dir), *_model(spark, sf_dir)))
    return _rounded(
        out, ["sample_id", "model_id"], ["score", "linear_predictor", "relative_hazard", "training_percentile"]
    )


def training_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile of every dense value among its feature's values, by rank."""
    cells = standins.dense_expression(spark, sf_dir).select("gene", "sample_id", F.col("value").alias("score"))
    out = inference.rank_percentiles(cells, inference.ranked_scores(cells.select("gene", "score"), ["gene"]), ["gene"])
    return _rounded(out, ["gene", "sample_id"], ["training_percentile"])


def predict_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches by vector class, one for each error code."""
    k = F.col("sample_id").cast("long") % 11
    cells = _requests(spark, sf_dir).withColumn("batch_id", F.concat(F.lit("b"), k.cast("string"))).withColumn("sample_pos", F.lit(0))
    twice = cells.filter(k == 8).withColumn("sample_pos", F.lit(1))
    more = cells.filter((k == 9) & (F.col("gene") == "d01")).withColumn("gene", F.lit("beyond"))
    huge = F.when((k == 10) & (F.col("gene") == "d05"), 1e300).otherwise(F.col("value"))
    cells = written(cells.unionByName(twice).unionByName(more).withColumn("value", huge), "requests")
    wanted = F.when(F.col("batch_id") == "b7", "nobody").otherwise("dense20")
    requests = cells.select("batch_id").distinct().withColumn("model_id", wanted)
    size = standins.dense_expression(spark, sf_dir).select("gene").distinct().count()
    out = inference.assess(cells, *_model(spark, sf_dir), requests, max_genes=size)
    return inference.rejects(out).select("sample_id", "error_code")


def matrix_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as batches of (part, supplier) cells: ragged and duplicated shapes."""
    lines = standins.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("b"), (F.col("l_orderkey") % 1000).cast("string")).alias("batch_id"),
        F.format_string("Brand#%d", F.col("l_partkey") % 3).alias("gene"),
        F.when(F.col("l_orderkey") % 5 == 0, F.format_string("Brand#%d", F.col("l_suppkey") % 4))
        .otherwise(F.col("l_suppkey").cast("string")).alias("sample_id"),
    )
    required = standins.signatures(spark).filter(F.col("signature") == "tiny")
    return inference.matrix_problems(lines, required)


# Folds and concordance ------------------------------------------------------------


def _population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis set of all segments as one cohort."""
    kept = endpoints.analysis_set(derived(spark, sf_dir)).withColumn("cohort_id", F.lit("all"))
    return written(kept.select("cohort_id", "sample_id", "time_months", "event", "c_acctbal"), "population")


def fold_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.plan(_population(spark, sf_dir), OUTER, INNER, REPEATS).select(
        "repeat", "fold", "inner_fold", "sample_id", "role"
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X9: held-out risks of two models over the fold plan."""
    population = _population(spark, sf_dir)
    tested = folds.test_folds(population, OUTER, REPEATS)
    matrix = standins.expression(spark, sf_dir, standins.signature_genes("s20")).withColumn("cohort_id", F.lit("all"))
    scored = scoring.score_rowmean(endpoints.restrict(matrix, population), _s20(spark), population=population)
    risks = (
        population.join(scored.select("sample_id", "score"), "sample_id")
        .select(
            "sample_id",
            "time_months",
            F.inline(
                F.array(
                    F.struct(F.lit("a").alias("model"), F.col("score").alias("risk")),
                    F.struct(F.lit("b").alias("model"), F.round("c_acctbal", -2).alias("risk")),
                )
            ),
        )
        .filter(F.col("risk").isNotNull())
    )
    held = tested.join(risks, "sample_id").select(
        "model", "repeat", "fold", "sample_id", "time_months", "event", "risk"
    )
    return written(held, "held-out")


def harrell_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.fold_concordance(predictions(spark, sf_dir))
    return _rounded(out, ["model", "repeat", "fold", "comparable_pairs"], ["c_index"])


def cv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.cv_summary(resample.fold_concordance(predictions(spark, sf_dir)))
    return _rounded(
        out, ["model", "n_fits"], ["mean_c", "sd_c", "median_c", "min_c", "max_c", "pair_weighted_c"]
    )


def paired_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.paired_differences(written(resample.fold_concordance(predictions(spark, sf_dir)), "fold-c"))
    return _rounded(
        out, ["comparison", "folds_positive", "n_outer_fits"],
        ["mean_difference", "sd_difference", "median_difference"],
    )


def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = predictions(spark, sf_dir)
    models, _ = resample.paired_bootstrap(held, DRAWS)
    return _rounded(models, ["model", "n_valid"], ["mean_c", "ci_low", "ci_high"])


def bootstrap_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the models' differences over the same draws."""
    _, pairs = resample.paired_bootstrap(predictions(spark, sf_dir), DRAWS)
    return _rounded(pairs, ["comparison", "n_valid", "too_few_valid"], ["mean_difference", "ci_low", "ci_high"])


def prediction_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects planted by segment size: a duplicate, a moved outcome, a missing repeat."""
    held = predictions(spark, sf_dir)
    k = F.col("sample_id").cast("long") % 17
    changed = (
        held.filter(~((k == 3) & (F.col("repeat") == 2)))
        .withColumn("time_months", F.when((k == 5) & (F.col("model") == "b"), F.col("time_months") + 1).otherwise(F.col("time_months")))
    )
    return resample.prediction_problems(changed.unionByName(changed.filter(k == 7)))


# Cox ---------------------------------------------------------------------------------


def _score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis set of every segment with its rowmean scores."""
    kept = written(endpoints.analysis_set(derived(spark, sf_dir)), "analysis-set")
    sig = standins.signatures(spark).filter(F.col("signature").isin("s20", "gap"))
    matrix = endpoints.restrict(standins.expression(spark, sf_dir, standins.signature_genes("s20")), kept)
    scored = scoring.score_rowmean(matrix, sig, population=kept)
    return written(kept.join(scored, ["cohort_id", "sample_id"]).select(
        "cohort_id", "signature", "sample_id", "time_months", "event", "score", "c_acctbal"
    ), "scored-set")


_COX = ["coefficient", "se", "hr", "ci_low", "ci_high", "c_index"]


def cox_per_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cox.per_sd(_score_rows(spark, sf_dir), ["cohort_id", "signature"])
    return _rounded(out, ["cohort_id", "signature", "n", "n_events"], _COX)


def cox_frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _score_rows(spark, sf_dir).filter(F.col("score").isNotNull()).withColumn("score", F.col("c_acctbal") / 5000)
    out = cox.frozen(rows, ["cohort_id", "signature"])
    return _rounded(out, ["cohort_id", "signature", "n", "n_events"], _COX)


def cox_quartile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cox.quartile(_score_rows(spark, sf_dir), ["cohort_id", "signature"])
    # Without events on one side the likelihood has no maximum.
    finite = F.least("events_q1", "events_q4") > 0
    out = out.withColumns({c: F.when(finite, F.col(c)) for c in _COX})
    return _rounded(
        out, ["cohort_id", "signature", "n", "n_events", "n_q1", "n_q4", "events_q1", "events_q4"], _COX
    )


def cox_multivariable(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cox.multivariable(_score_rows(spark, sf_dir), ["cohort_id", "signature"], ["score", "c_acctbal"])
    return _rounded(out, ["cohort_id", "signature", "term", "n", "n_events", "converged"], [*_COX, "p"])


# Cross-validation ------------------------------------------------------------------


def _cv_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    population = _population(spark, sf_dir)
    matrix = written(
        endpoints.restrict(standins.filled_expression(spark, sf_dir, CV_GENES), population), "cv-matrix"
    )
    return population, matrix, written(folds.plan(population, OUTER, INNER, REPEATS), "cv-plan")


def nested_cv_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    population, matrix, plan = _cv_inputs(spark, sf_dir)
    out = crossval.fixed_signature_cv(matrix, population, plan)["folds"]
    return _rounded(out, ["repeat", "fold", "n_train", "n_test"], ["coefficient", "c_index"])


def cv_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohorts with equal sample ids: one as it is, one rescaled, one with a constant gene."""
    population, matrix, plan = _cv_inputs(spark, sf_dir)
    named = F.explode(F.array(*[F.lit(c) for c in "abc"]))
    value = (
        F.when(F.col("cohort_id") == "b", 7 + 3 * F.col("value"))
        .when((F.col("cohort_id") == "c") & (F.col("gene") == CV_GENES[0]), 1.0)
        .otherwise(F.col("value"))
    )
    many = matrix.withColumn("cohort_id", named).withColumn("value", value)
    out = crossval.fixed_signature_cv(
        written(many, "cohorts-matrix"), population.withColumn("cohort_id", named), written(plan.withColumn("cohort_id", named), "cohorts-plan")
    )["folds"]
    return _rounded(out, ["cohort_id", "repeat", "fold", "error"], ["coefficient", "c_index"])


def cox_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key for each reason to refuse a fit, and one that is fitted."""
    k = F.col("sample_id").cast("long") % 8
    first = F.row_number().over(Window.partitionBy("cohort_id").orderBy("sample_id")) == 1
    rows = _population(spark, sf_dir).withColumn("cohort_id", F.concat(F.lit("k"), k.cast("string")))
    rows = rows.withColumn("_first", first).filter((k != 4) | F.col("_first"))
    rows = (
        rows.withColumn("score", F.when(k == 0, 2.0).when(k == 5, F.lit(None)).otherwise(F.col("c_acctbal")))
        .withColumn("score", F.when((k == 1) & F.col("_first"), float("inf")).otherwise(F.col("score")))
        .withColumn("score", F.when(k == 6, F.signum("c_acctbal")).otherwise(F.col("score")))
        .withColumn("event", F.when((k == 2) & F.col("_first"), 2).otherwise(F.col("event")))
        .withColumn("time_months", F.when((k == 3) & F.col("_first"), 0.0).otherwise(F.col("time_months")))
    )
    return cox.per_sd(rows, ["cohort_id"]).select("cohort_id", "error")


def candidate_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composites over growing gene sets, chosen by mean inner C."""
    population, matrix, plan = _cv_inputs(spark, sf_dir)
    sets: dict[int, list[str]] = {}
    for candidate, gene in CANDIDATES:
        sets.setdefault(candidate, []).append(gene)
    inner = crossval.composite_search(matrix, population, plan, sets)
    out = crossval.select_candidates(inner, ["repeat", "fold"], INNER)
    return _rounded(out, ["repeat", "fold", "candidate"], ["mean_c"])


def _fold_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per training fold and feature: thresholded mean difference between outcomes."""
    _, matrix, plan = _cv_inputs(spark, sf_dir)
    train = plan.filter(F.col("role") == "train")
    diff = F.avg(F.when(F.col("event") == 1, F.col("value"))) - F.avg(F.when(F.col("event") == 0, F.col("value")))
    effects = crossval.cells_of(matrix, train).groupBy(
        "repeat", "fold", F.col("gene").alias("feature")
    ).agg(diff.alias("d"))
    return effects.withColumn("coefficient", F.when(F.abs("d") < 0.2, 0.0).otherwise(F.col("d")))


def coefficient_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.coefficient_stability(_fold_effects(spark, sf_dir))
    return _rounded(
        out, ["feature", "n_fits", "n_nonzero", "positive_fits", "negative_fits"],
        ["selection_frequency", "sign_consistency", "mean", "sd", "median", "q25", "q75", "min", "max"],
    )


def _net(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    population, matrix, plan = _cv_inputs(spark, sf_dir)
    grid = literal_rows(spark, NET_GRID, "candidate int, alpha double, l1_ratio double")
    return crossval.penalised_cv(matrix, population, plan, CV_GENES, grid, INNER)


def coxnet_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the elastic net selects in each outer fold, and how it does there."""
    out = _net(spark, sf_dir)
    chosen = out["selected"].select("repeat", "fold", "mean_c")
    sizes = out["coefficients"].groupBy("repeat", "fold").agg(
        F.count_if(F.col("coefficient") != 0).cast("long").alias("n_selected")
    )
    held = out["folds"].select("repeat", "fold", "candidate", "c_index", "error")
    joined = held.join(chosen, ["repeat", "fold"], "left").join(sizes, ["repeat", "fold"], "left")
    return _rounded(joined, ["repeat", "fold", "candidate", "n_selected", "error"], ["mean_c", "c_index"])


def coxnet_certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every inner fit of the grid with its certificate: the optimality conditions hold to 1e-6."""
    search = _net(spark, sf_dir)["search"]
    return search.select(
        "repeat", "fold", "inner_fold", "candidate", "n_train", "n_events",
        (F.col("residual") <= 1e-6).cast("int").alias("certified"), "error",
    )


def final_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain folds in which the final model's penalty is chosen."""
    return folds.whole_plan(_population(spark, sf_dir), FINAL_FOLDS).select("inner_fold", "sample_id", "role")


def _final(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """Final models of two cohorts with equal sample ids: one as it is, one in which nothing happens."""
    population, matrix, _ = _cv_inputs(spark, sf_dir)
    named = F.explode(F.array(F.lit("a"), F.lit("b")))
    event = F.when(F.col("cohort_id") == "b", 0).otherwise(F.col("event"))
    both = written(population.withColumn("cohort_id", named).withColumn("event", event), "final-population")
    cells = written(matrix.withColumn("cohort_id", named), "final-matrix")
    grid = literal_rows(spark, NET_GRID, "candidate int, alpha double, l1_ratio double")
    plan = written(folds.whole_plan(both, FINAL_FOLDS), "final-plan")
    return cells, both, crossval.fit_final(cells, both, plan, CV_GENES, grid, FINAL_FOLDS)


def final_certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fit of the final search, and with inner fold 0 the model itself: sizes, and whether its conditions hold to 1e-6."""
    _, _, out = _final(spark, sf_dir)
    certified = (F.col("residual") <= 1e-6).cast("int").alias("certified")
    search = out["search"].select("cohort_id", "inner_fold", "candidate", "n_train", "n_events", certified, "error")
    model = out["model"].select("cohort_id", F.lit(0), F.lit(None).cast("int"), "n_train", "n_events", certified, "error")
    return search.unionAll(model)


def final_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final model of each cohort: its setting, coefficients and scaler."""
    _, _, out = _final(spark, sf_dir)
    parts = out["coefficients"].withColumnRenamed("feature", "gene").join(out["scaler"], ["cohort_id", "gene"])
    joined = out["model"].join(parts, "cohort_id", "left")
    return _rounded(
        joined, ["cohort_id", "candidate", "n_scored", "n_selected", "error", "gene", "n_fit"], ["mean_c", "coefficient", "mean", "sd"]
    )


def _drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permutation drops of an equal-weight composite on frozen training statistics."""
    population, matrix, plan = _cv_inputs(spark, sf_dir)
    keys = ["repeat", "fold"]
    cells = crossval.cells_of(matrix, plan.select("cohort_id", *keys, "sample_id", "role"))
    fitted = scaler.fit(cells.filter(F.col("role") == "train"), keys)
    features = cells.filter(F.col("role") == "test").join(fitted, [*keys, "gene"]).select(
        *keys, "sample_id", "gene", ((F.col("value") - F.col("mean")) / F.col("sd")).alias("z")
    )
    features = written(features, "importance-features")
    weights = features.select(*keys, "gene").distinct().withColumn("coefficient", F.lit(0.05))
    return resample.permutation_drops(features, population, weights, keys, PERMUTATIONS)


def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_drops(spark, sf_dir), ["repeat", "fold", "gene", "permutation"], ["c_drop"])


def importance_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.importance_rollup(_drops(spark, sf_dir))
    return _rounded(out, ["gene", "rank"], ["mean", "sd", "median", "min", "max", "fraction_folds_positive"])


def importance_rank_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.importance_rank_correlation(written(_drops(spark, sf_dir), "drops"))
    return _rounded(out, ["repeat_a", "repeat_b"], ["spearman"])


# Oracle SQL -----------------------------------------------------------------------------

_HALF = f"""{X1},
h AS (SELECT *, ('0x' || md5(sample_id)[1:1])::INTEGER % 2 = 0 AS train FROM x1 WHERE gene IN ({S.brands(20)})),
sizes AS (SELECT cohort_id, count(DISTINCT sample_id) AS n_fit FROM h WHERE train GROUP BY 1),
sc AS (SELECT cohort_id AS scaler_id, gene, avg(value) AS mean,
              CASE WHEN stddev_samp(value) >= 1e-8 THEN stddev_samp(value) END AS sd, any_value(n_fit) AS n_fit
       FROM h JOIN sizes USING (cohort_id) WHERE train AND n_fit >= 2 GROUP BY 1, 2)"""

_REFERENCE = f"""WITH {_HALF},
test AS (SELECT * FROM h WHERE NOT train),
pr AS (SELECT g.cohort_id, scaler_id, count(*) AS n_present
       FROM (SELECT DISTINCT cohort_id, gene FROM test) g JOIN sc USING (gene) GROUP BY 1, 2),
z AS (SELECT test.cohort_id, scaler_id, sample_id, sum(coalesce((value - mean) / sd, 0)) AS z
      FROM test JOIN sc USING (gene) GROUP BY 1, 2, 3)
SELECT p.cohort_id, scaler_id || '/s20' AS reference_id, p.sample_id, n_present, {r('coalesce(z, 0) / n_present')} AS score
FROM (SELECT DISTINCT cohort_id, sample_id FROM test) p JOIN pr USING (cohort_id)
LEFT JOIN z USING (cohort_id, scaler_id, sample_id)"""

_IDENTITY = f"""WITH {_HALF},
ids AS (SELECT DISTINCT cohort_id, sample_id FROM h WHERE train),
hs AS (SELECT cohort_id, 'sha256:' || sha256(string_agg(sample_id, chr(10) ORDER BY sample_id)) AS population_hash FROM ids GROUP BY 1)
SELECT scaler_id || '/s20' AS reference_id, any_value(population_hash) AS population_hash, count(*) AS n_genes, max(n_fit) AS n_train
FROM sc JOIN hs ON scaler_id = cohort_id GROUP BY 1"""

_MODEL = f"""{X2},
m AS (SELECT * FROM x2 WHERE pos < 20),
tr AS (SELECT * FROM m),
sc AS (SELECT gene, avg(value) AS mean, CASE WHEN stddev_samp(value) >= 1e-8 THEN stddev_samp(value) END AS sd FROM tr GROUP BY 1),
raw AS (SELECT sample_id, avg(coalesce((value - mean) / sd, 0)) AS raw FROM tr JOIN sc USING (gene) GROUP BY 1),
cs AS (SELECT avg(raw) AS cm, stddev_samp(raw) AS csd FROM raw),
ref AS (SELECT (raw - cm) / csd AS s FROM raw, cs),
req AS (SELECT sample_id, gene, CAST(sample_id AS BIGINT) % 11 AS k, value FROM m)"""

_PREDICT = f"""WITH {_MODEL},
z AS (SELECT sample_id, sum((value - mean) / sd) / 20 AS raw FROM req JOIN sc USING (gene)
      WHERE k NOT IN (3, 4, 5, 6) GROUP BY 1),
s AS (SELECT sample_id, (raw - cm) / csd AS score FROM z, cs)
SELECT sample_id, 'dense20' AS model_id, {r('score')} AS score, {r('score * 0.58e0')} AS linear_predictor,
       {r('exp(score * 0.58e0)')} AS relative_hazard,
       {r('100e0 * (SELECT count(*) FROM ref WHERE ref.s <= score) / (SELECT count(*) FROM ref)')} AS training_percentile
FROM s"""

_REJECTS = """
SELECT CAST(vec_id AS VARCHAR) AS sample_id,
       CASE vec_id % 11 WHEN 3 THEN 'MISSING_REQUIRED_GENES' WHEN 4 THEN 'NONFINITE_EXPRESSION'
            WHEN 5 THEN 'INCOMPATIBLE_EXPRESSION_TYPE' WHEN 6 THEN 'DUPLICATE_REQUIRED_GENES' WHEN 7 THEN 'MODEL_NOT_FOUND'
            WHEN 8 THEN 'DUPLICATE_SAMPLE_IDS' WHEN 9 THEN 'REQUEST_TOO_LARGE' ELSE 'INVALID_MATRIX' END AS error_code
FROM embeddings WHERE vec_id % 11 >= 3"""

_SHAPES = """
WITH c AS (SELECT 'b' || (l_orderkey % 1000) AS batch_id, 'Brand#' || (l_partkey % 3) AS gene,
                  CASE WHEN l_orderkey % 5 = 0 THEN 'Brand#' || (l_suppkey % 4) ELSE CAST(l_suppkey AS VARCHAR) END AS sample_id
           FROM lineitem),
s AS (SELECT batch_id, count(DISTINCT gene) AS g, count(DISTINCT sample_id) AS s, count(DISTINCT gene || '|' || sample_id) AS d,
             count(*) AS n, bool_or(gene IN ('Brand#1', 'Brand#2')) AS ok, bool_or(sample_id IN ('Brand#1', 'Brand#2')) AS t
      FROM c GROUP BY 1),
p AS (SELECT batch_id, CASE WHEN n > d THEN 'duplicate_cells' WHEN t AND NOT ok THEN 'transposed' WHEN d <> g * s THEN 'ragged' END AS problem FROM s)
SELECT batch_id, problem FROM p WHERE problem IS NOT NULL"""

_POP = "pop AS (SELECT sample_id, event, time_months, c_acctbal FROM aset)"

_PLAN = f"WITH {X6}, {_POP}, {S.tested(OUTER, REPEATS)}, {S.roles(OUTER, INNER)} SELECT repeat, fold, inner_fold, sample_id, role FROM roles"

_PREDICTIONS = f"""{X1}, {X6}, {_POP},
cells AS (SELECT 'all' AS cohort_id, gene, sample_id, value FROM x1 SEMI JOIN pop USING (sample_id)),
{S.z_scores('cohort_id', 'cells', S.brands(20), 'sco')},
{S.tested(OUTER, REPEATS)},
held AS (SELECT 'a' AS model, repeat, fold, t.sample_id, time_months, event, score AS risk FROM tested t JOIN sco USING (sample_id) WHERE score IS NOT NULL
         UNION ALL SELECT 'b', repeat, fold, t.sample_id, t.time_months, t.event, round(c_acctbal, -2) FROM tested t JOIN pop USING (sample_id) JOIN (SELECT DISTINCT sample_id FROM cells) USING (sample_id)
         UNION ALL SELECT 'b', repeat, fold, t.sample_id, t.time_months, t.event, round(c_acctbal, -2) FROM tested t JOIN pop USING (sample_id) ANTI JOIN (SELECT DISTINCT sample_id FROM cells) c USING (sample_id)),
{S.concordance('held', 'model, repeat, fold')}"""

_SUMMARY = f"""WITH {_PREDICTIONS}
SELECT model, count(*) AS n_fits, {r('avg(c_index)')} AS mean_c, {r('stddev_samp(c_index)')} AS sd_c, {r('median(c_index)')} AS median_c,
       {r('min(c_index)')} AS min_c, {r('max(c_index)')} AS max_c,
       {r('sum(c_index * comparable_pairs) / sum(comparable_pairs)')} AS pair_weighted_c
FROM conc GROUP BY 1"""

_DIFFERENCE = f"""WITH {_PREDICTIONS},
d AS (SELECT b.c_index - a.c_index AS d FROM conc a JOIN conc b USING (repeat, fold) WHERE a.model = 'a' AND b.model = 'b')
SELECT 'b minus a' AS comparison, count(*) FILTER (d > 0) AS folds_positive, count(*) AS n_outer_fits, {r('avg(d)')} AS mean_difference,
       {r('stddev_samp(d)')} AS sd_difference, {r('median(d)')} AS median_difference FROM d"""

_DRAWS_SQL = f"""WITH {_PREDICTIONS},
pat AS (SELECT sample_id, row_number() OVER (ORDER BY md5(sample_id), sample_id) - 1 AS slot FROM (SELECT DISTINCT sample_id FROM held)),
nn AS (SELECT count(*) AS n FROM pat),
hit AS (SELECT draw, ('0x' || md5(concat_ws('|', '902099', draw, slot))[1:15])::BIGINT % n AS slot, count(*) AS weight
        FROM pat, nn, (SELECT unnest(range(1, {DRAWS + 1})) AS draw) GROUP BY 1, 2),
wt AS (SELECT draw, sample_id, weight FROM hit JOIN pat USING (slot)),
pairs AS (SELECT i.model, i.repeat, i.fold, i.sample_id AS a, j.sample_id AS b,
                 CASE WHEN i.risk - j.risk > 1e-8 THEN 1e0 WHEN abs(i.risk - j.risk) <= 1e-8 THEN 0.5e0 ELSE 0e0 END AS credit
          FROM held i JOIN held j ON i.model = j.model AND i.repeat = j.repeat AND i.fold = j.fold AND i.event = 1
           AND (i.time_months < j.time_months OR (i.time_months = j.time_months AND j.event = 0))),
fc AS (SELECT model, repeat, fold, wa.draw, sum(wa.weight * wb.weight * credit) / sum(wa.weight * wb.weight) AS c
       FROM pairs JOIN wt wa ON a = wa.sample_id JOIN wt wb ON b = wb.sample_id AND wa.draw = wb.draw GROUP BY 1, 2, 3, 4),
dc AS (SELECT model, draw, avg(c) AS c, count(*) AS k FROM fc GROUP BY 1, 2),
ok AS (SELECT draw FROM dc GROUP BY 1 HAVING min(k) = {OUTER * REPEATS})"""

_BOOTSTRAP = f"""{_DRAWS_SQL},
ci AS (SELECT model, quantile_cont(c, 0.025) AS lo, quantile_cont(c, 0.975) AS hi, count(*) AS n_valid FROM dc SEMI JOIN ok USING (draw) GROUP BY 1),
ms AS (SELECT model, avg(c_index) AS mc FROM conc GROUP BY 1)
SELECT model, n_valid, {r('mc')} AS mean_c, {r('lo')} AS ci_low, {r('hi')} AS ci_high FROM ci JOIN ms USING (model)"""

_BOOTSTRAP_DIFFERENCES = f"""{_DRAWS_SQL},
dd AS (SELECT b.c - a.c AS d FROM dc a JOIN dc b USING (draw) SEMI JOIN ok USING (draw) WHERE a.model = 'a' AND b.model = 'b'),
md AS (SELECT avg(b.c_index - a.c_index) AS m FROM conc a JOIN conc b USING (repeat, fold) WHERE a.model = 'a' AND b.model = 'b')
SELECT 'b minus a' AS comparison, count(*) AS n_valid, count(*) < {DRAWS} * 0.8 AS too_few_valid, {r('any_value(m)')} AS mean_difference,
       {r('quantile_cont(d, 0.025)')} AS ci_low, {r('quantile_cont(d, 0.975)')} AS ci_high FROM dd, md"""

_PROBLEMS = f"""WITH {_PREDICTIONS},
ch AS (SELECT model, repeat, fold, sample_id, event, CAST(sample_id AS BIGINT) % 17 AS k,
              CASE WHEN CAST(sample_id AS BIGINT) % 17 = 5 AND model = 'b' THEN time_months + 1 ELSE time_months END AS t
       FROM held WHERE NOT (CAST(sample_id AS BIGINT) % 17 = 3 AND repeat = 2)),
al AS (SELECT * FROM ch UNION ALL SELECT * FROM ch WHERE k = 7)
SELECT problem, n FROM (
SELECT 'duplicate_prediction' AS problem, (SELECT count(*) FROM (SELECT 1 FROM al GROUP BY model, repeat, sample_id HAVING count(*) > 1)) AS n
UNION ALL SELECT 'unpaired_prediction', (SELECT count(*) FROM (SELECT 1 FROM al GROUP BY repeat, sample_id
  HAVING min(t) <> max(t) OR min(fold) <> max(fold) OR count(DISTINCT model) <> 2))
UNION ALL SELECT 'patient_missing_from_repeat', (SELECT count(*) FROM (SELECT 1 FROM al GROUP BY sample_id HAVING count(DISTINCT repeat) <> {REPEATS}))
) WHERE n > 0"""

_SCORED = f"""{S.SCORES},
{S.z_scores('cohort_id', 'kept', S.brands(20), 'za')},
{S.z_scores('cohort_id', 'kept', S.brands(4), 'zb')},
rows_ AS (SELECT cohort_id, 's20' AS signature, sample_id, time_months, event, score, c_acctbal FROM aset JOIN za USING (cohort_id, sample_id) WHERE score IS NOT NULL
          UNION ALL SELECT cohort_id, 'gap', sample_id, time_months, event, score, c_acctbal FROM aset JOIN zb USING (cohort_id, sample_id) WHERE score IS NOT NULL)"""


def _cox_sql(source: str, extra: str = "", more: str = "") -> str:
    keys = "cohort_id, signature"
    columns = ", ".join(
        f"{r(e)} AS {c}"
        for c, e in {
            "coefficient": "coefficient", "se": "se", "hr": "exp(coefficient)",
            "ci_low": "exp(coefficient - 1.959963984540054e0 * se)",
            "ci_high": "exp(coefficient + 1.959963984540054e0 * se)", "c_index": "c_index",
        }.items()
    )
    return f"""WITH {_SCORED}, {source},
{S.newton('src', keys)},
rk AS (SELECT {keys}, time_months, event, coefficient * z AS risk FROM src JOIN cx_fit USING ({keys})),
{S.concordance('rk', keys)},
sz AS (SELECT {keys}, count(*) AS n, CAST(sum(event) AS BIGINT) AS n_events{extra} FROM src GROUP BY {keys})
SELECT {keys}, n, n_events, {more}{columns} FROM sz JOIN cx_fit USING ({keys}) JOIN conc USING ({keys})"""


_PER_SD = _cox_sql(
    """st AS (SELECT cohort_id, signature, avg(score) AS m, stddev_samp(score) AS s FROM rows_ GROUP BY 1, 2),
src AS (SELECT cohort_id, signature, time_months, event, (score - m) / s AS z FROM rows_ JOIN st USING (cohort_id, signature))"""
)
_FROZEN = _cox_sql(
    "src AS (SELECT cohort_id, signature, time_months, event, c_acctbal / 5000 AS z FROM rows_)"
)
_QUARTILE = _cox_sql(
    """qs AS (SELECT cohort_id, signature, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.75) AS q3 FROM rows_ GROUP BY 1, 2),
src AS (SELECT cohort_id, signature, time_months, event, CASE WHEN score <= q1 THEN 0e0 ELSE 1e0 END AS z FROM rows_ JOIN qs USING (cohort_id, signature) WHERE score <= q1 OR score >= q3)""",
    ", count(*) FILTER (z = 0) AS n_q1, count(*) FILTER (z = 1) AS n_q4, count(*) FILTER (z = 0 AND event = 1) AS events_q1, count(*) FILTER (z = 1 AND event = 1) AS events_q4",
    "n_q1, n_q4, events_q1, events_q4, ",
)
_QUARTILE = f"""SELECT cohort_id, signature, n, n_events, n_q1, n_q4, events_q1, events_q4,
{", ".join(f"CASE WHEN least(events_q1, events_q4) > 0 THEN {c} END AS {c}" for c in _COX)} FROM ({_QUARTILE})"""

_CV = f"""{X1}, {X6}, {_POP}, {S.tested(OUTER, REPEATS)}, {S.roles(OUTER, INNER)},
grid AS (SELECT pop.sample_id, g.gene, coalesce(x1.value, 0) AS value
         FROM pop CROSS JOIN (SELECT unnest([{S.brands(20)}]) AS gene) g
         LEFT JOIN x1 ON x1.sample_id = pop.sample_id AND x1.gene = g.gene)"""

_NESTED = f"""WITH {_CV},
cells AS (SELECT repeat, fold, role, sample_id, gene, value FROM roles JOIN grid USING (sample_id)),
st AS (SELECT repeat, fold, gene, avg(value) AS m, stddev_samp(value) AS s FROM cells WHERE role = 'train' GROUP BY 1, 2, 3),
raw AS (SELECT repeat, fold, role, sample_id, avg((value - m) / s) AS raw FROM cells JOIN st USING (repeat, fold, gene) GROUP BY 1, 2, 3, 4),
cs AS (SELECT repeat, fold, avg(raw) AS cm, stddev_samp(raw) AS csd FROM raw WHERE role = 'train' GROUP BY 1, 2),
zz AS (SELECT repeat, fold, role, sample_id, time_months, event, (raw - cm) / csd AS z FROM raw JOIN cs USING (repeat, fold) JOIN pop USING (sample_id)),
src AS (SELECT * FROM zz WHERE role = 'train'),
{S.newton('src', 'repeat, fold')},
rk AS (SELECT repeat, fold, time_months, event, coefficient * z AS risk FROM zz JOIN cx_fit USING (repeat, fold) WHERE role = 'test'),
{S.concordance('rk', 'repeat, fold')},
sz AS (SELECT repeat, fold, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'test') AS n_test FROM zz GROUP BY 1, 2)
SELECT repeat, fold, n_train, n_test, {r('coefficient')} AS coefficient, {r('c_index')} AS c_index
FROM sz JOIN cx_fit USING (repeat, fold) JOIN conc USING (repeat, fold)"""

_COHORTS = f"""SELECT c AS cohort_id, repeat, fold, CASE WHEN c = 'c' THEN 'constant_training_gene' END AS error,
       CASE WHEN c <> 'c' THEN coefficient END AS coefficient, CASE WHEN c <> 'c' THEN c_index END AS c_index
FROM ({_NESTED}), (SELECT unnest(['a', 'b', 'c']) AS c)"""

_COX_REFUSALS = f"""WITH {X6}, {_POP}
SELECT DISTINCT 'k' || (CAST(sample_id AS BIGINT) % 8) AS cohort_id,
       CASE CAST(sample_id AS BIGINT) % 8 WHEN 0 THEN 'constant_score' WHEN 1 THEN 'score_not_finite' WHEN 2 THEN 'event_not_0_1'
            WHEN 3 THEN 'time_not_positive' WHEN 4 THEN 'constant_score' WHEN 5 THEN 'score_missing' WHEN 6 THEN 'few_distinct_values' END AS error
FROM pop"""

_CANDIDATE_ROWS = ", ".join(f"({k}, '{g}')" for k, g in CANDIDATES)
_CANDIDATE = f"""WITH {_CV}, cand(candidate, gene) AS (SELECT * FROM (VALUES {_CANDIDATE_ROWS})),
inn AS (SELECT repeat, fold, i.inner_fold AS inner_fold, sample_id, event, time_months, roles.inner_fold = i.inner_fold AS val
        FROM roles, (SELECT unnest(range(1, {INNER + 1})) AS inner_fold) i WHERE role = 'train'),
cells AS (SELECT * FROM inn JOIN grid USING (sample_id)),
st AS (SELECT repeat, fold, inner_fold, gene, avg(value) AS m, stddev_samp(value) AS s FROM cells WHERE NOT val GROUP BY 1, 2, 3, 4),
rk AS (SELECT repeat, fold, inner_fold, candidate, sample_id, any_value(time_months) AS time_months, any_value(event) AS event, avg((value - m) / s) AS risk
       FROM cells JOIN st USING (repeat, fold, inner_fold, gene) JOIN cand USING (gene) WHERE val GROUP BY 1, 2, 3, 4, 5),
{S.concordance('rk', 'repeat, fold, inner_fold, candidate')},
mc AS (SELECT repeat, fold, candidate, avg(c_index) AS mean_c FROM conc GROUP BY 1, 2, 3 HAVING count(*) = {INNER})
SELECT repeat, fold, CAST(candidate AS INTEGER) AS candidate, {r('mean_c')} AS mean_c FROM mc
QUALIFY row_number() OVER (PARTITION BY repeat, fold ORDER BY mean_c DESC, candidate) = 1"""

_CERTIFICATES = f"""WITH {X6}, {_POP}, {S.tested(OUTER, REPEATS)}, {S.roles(OUTER, INNER)}
SELECT repeat, fold, CAST(i.inner_fold AS INTEGER) AS inner_fold, CAST(c.candidate AS INTEGER) AS candidate,
       count(*) FILTER (roles.inner_fold <> i.inner_fold) AS n_train,
       CAST(sum(event) FILTER (roles.inner_fold <> i.inner_fold) AS BIGINT) AS n_events, 1 AS certified, CAST(NULL AS VARCHAR) AS error
FROM roles, (SELECT unnest(range(1, {INNER + 1})) AS inner_fold) i, (SELECT unnest(range({len(NET_GRID)})) AS candidate) c
WHERE role = 'train' GROUP BY 1, 2, 3, 4"""

_FINAL_PLAN = f"""WITH {X6}, {_POP}
SELECT CAST((row_number() OVER (ORDER BY md5(concat_ws('|', '902001', sample_id)), sample_id) - 1) % {FINAL_FOLDS} + 1 AS INTEGER) AS inner_fold,
       sample_id, 'train' AS role FROM pop"""

_FINAL_CERTIFICATES = f"""WITH {X6}, {_POP},
placed AS (SELECT event, (row_number() OVER (ORDER BY md5(concat_ws('|', '902001', sample_id)), sample_id) - 1) % {FINAL_FOLDS} + 1 AS own FROM pop),
sizes AS (SELECT inner_fold, count(*) FILTER (own <> inner_fold) AS n, CAST(coalesce(sum(event) FILTER (own <> inner_fold), 0) AS BIGINT) AS n_events
          FROM placed, (SELECT unnest(range(0, {FINAL_FOLDS + 1})) AS inner_fold) GROUP BY 1),
named AS (SELECT * FROM sizes, (VALUES ('a'), ('b')) c(cohort_id))
SELECT cohort_id, CAST(inner_fold AS INTEGER) AS inner_fold, CAST(candidate AS INTEGER) AS candidate, n AS n_train,
       CASE cohort_id WHEN 'a' THEN n_events ELSE 0 END AS n_events, CASE cohort_id WHEN 'a' THEN 1 END AS certified,
       CASE WHEN cohort_id = 'b' THEN CASE WHEN inner_fold > 0 THEN 'no_training_events' ELSE 'no_usable_candidate' END END AS error
FROM named, LATERAL (SELECT unnest(CASE WHEN inner_fold > 0 THEN range({len(NET_GRID)}) ELSE [NULL] END) AS candidate)"""

_STABILITY = f"""WITH {_CV},
e AS (SELECT repeat, fold, gene AS feature, avg(value) FILTER (event = 1) - avg(value) FILTER (event = 0) AS d
      FROM roles JOIN grid USING (sample_id) WHERE role = 'train' GROUP BY 1, 2, 3),
c AS (SELECT feature, CASE WHEN abs(d) < 0.2 THEN 0e0 ELSE d END AS v FROM e)
SELECT feature, count(*) AS n_fits, count(*) FILTER (v <> 0) AS n_nonzero, count(*) FILTER (v > 0) AS positive_fits,
       count(*) FILTER (v < 0) AS negative_fits, {r('avg(CAST(v <> 0 AS DOUBLE))')} AS selection_frequency,
       {r('greatest(count(*) FILTER (v > 0), count(*) FILTER (v < 0)) * 1e0 / nullif(count(*) FILTER (v <> 0), 0)')} AS sign_consistency,
       {r('avg(v)')} AS mean, {r('stddev_samp(v)')} AS sd, {r('median(v)')} AS median, {r('quantile_cont(v, 0.25)')} AS q25,
       {r('quantile_cont(v, 0.75)')} AS q75, {r('min(v)')} AS min, {r('max(v)')} AS max
FROM c GROUP BY 1"""

_DROPS = f"""WITH {_CV},
cells AS (SELECT repeat, fold, role, sample_id, gene, value FROM roles JOIN grid USING (sample_id)),
st AS (SELECT repeat, fold, gene, avg(value) AS m, stddev_samp(value) AS s FROM cells WHERE role = 'train' GROUP BY 1, 2, 3),
part AS MATERIALIZED (SELECT repeat, fold, sample_id, gene, 0.05e0 * (value - m) / s AS part FROM cells JOIN st USING (repeat, fold, gene) WHERE role = 'test'),
base AS (SELECT repeat, fold, sample_id, sum(part) AS risk FROM part GROUP BY 1, 2, 3),
wr AS (SELECT repeat, fold, time_months, event, risk FROM base JOIN pop USING (sample_id)),
{S.concordance('wr', 'repeat, fold', 'whole')},
many AS (SELECT *, CAST(unnest(range(1, {PERMUTATIONS + 1})) AS INTEGER) AS permutation FROM part),
slots AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY repeat, fold, gene, permutation ORDER BY md5(sample_id), sample_id) AS taker,
                 row_number() OVER (PARTITION BY repeat, fold, gene, permutation
                   ORDER BY md5(concat_ws('|', '932001', repeat, fold, gene, permutation, sample_id)), sample_id) AS giver FROM many),
swapped AS (SELECT a.repeat, a.fold, a.gene, a.permutation, a.sample_id, a.part, b.part AS given
            FROM slots a JOIN slots b ON a.repeat = b.repeat AND a.fold = b.fold AND a.gene = b.gene AND a.permutation = b.permutation AND a.taker = b.giver),
pr AS MATERIALIZED (SELECT s.repeat, s.fold, s.gene, s.permutation, time_months, event, base.risk - part + given AS risk
       FROM swapped s JOIN base ON s.repeat = base.repeat AND s.fold = base.fold AND s.sample_id = base.sample_id JOIN pop ON pop.sample_id = s.sample_id),
{S.concordance('pr', 'repeat, fold, gene, permutation', 'perm')},
drops AS (SELECT perm.repeat, perm.fold, gene, permutation, whole.c_index - perm.c_index AS c_drop FROM perm JOIN whole ON perm.repeat = whole.repeat AND perm.fold = whole.fold),
byf AS (SELECT repeat, fold, gene, avg(c_drop) AS c_drop FROM drops GROUP BY 1, 2, 3)"""

_ROLLUP = f"""{_DROPS}
SELECT gene, CAST(row_number() OVER (ORDER BY round(avg(c_drop), 9) DESC, gene) AS INT) AS rank,
       {r('avg(c_drop)')} AS mean, {r('stddev_samp(c_drop)')} AS sd, {r('median(c_drop)')} AS median, {r('min(c_drop)')} AS min,
       {r('max(c_drop)')} AS max, {r('avg(CAST(c_drop > 0 AS DOUBLE))')} AS fraction_folds_positive FROM byf GROUP BY 1"""

_RANK = f"""{_DROPS},
rp AS (SELECT repeat, gene, avg(c_drop) AS c FROM byf GROUP BY 1, 2),
rr AS (SELECT repeat, gene, rank() OVER (PARTITION BY repeat ORDER BY c) + (count(*) OVER (PARTITION BY repeat, c) - 1) / 2e0 AS rk FROM rp)
SELECT a.repeat AS repeat_a, b.repeat AS repeat_b, {r('corr(a.rk, b.rk)')} AS spearman FROM rr a JOIN rr b USING (gene) GROUP BY 1, 2"""

QUERIES = {
    "scaler_fit": (
        scaler_fit,
        f"WITH {_HALF} SELECT scaler_id, gene, n_fit, {r('mean')} AS mean, {r('sd')} AS sd FROM sc",
    ),
    "reference_score": (reference_score, _REFERENCE),
    "reference_identity": (reference_identity, _IDENTITY),
    "leakage_check": (leakage_check, f"WITH {_HALF} SELECT cohort_id, n_fit AS n_train, 1 AS unchanged, 0 AS control_unchanged FROM sizes"),
    "frozen_predict": (frozen_predict, _PREDICT),
    "training_percentile": (
        training_percentile,
        f"WITH {X2} SELECT gene, sample_id, "
        + r("100e0 * count(*) OVER (PARTITION BY gene ORDER BY value RANGE UNBOUNDED PRECEDING) / count(*) OVER (PARTITION BY gene)")
        + " AS training_percentile FROM x2",
    ),
    "predict_rejects": (predict_rejects, _REJECTS),
    "matrix_problems": (matrix_problems, _SHAPES),
    "fold_plan": (fold_plan, _PLAN),
    "harrell_c": (
        harrell_c,
        f"WITH {_PREDICTIONS} SELECT model, repeat, fold, comparable_pairs, {r('c_index')} AS c_index FROM conc",
    ),
    "cv_summary": (cv_summary, _SUMMARY),
    "paired_difference": (paired_difference, _DIFFERENCE),
    "paired_bootstrap": (paired_bootstrap, _BOOTSTRAP),
    "bootstrap_differences": (bootstrap_differences, _BOOTSTRAP_DIFFERENCES),
    "prediction_problems": (prediction_problems, _PROBLEMS),
    "cox_per_sd": (cox_per_sd, _PER_SD),
    "cox_frozen": (cox_frozen, _FROZEN),
    "cox_quartile": (cox_quartile, _QUARTILE),
    "cox_multivariable": (cox_multivariable, None),
    "nested_cv_fixed": (nested_cv_fixed, _NESTED),
    "cv_cohorts": (cv_cohorts, _COHORTS),
    "cox_refusals": (cox_refusals, _COX_REFUSALS),
    "candidate_selection": (candidate_selection, _CANDIDATE),
    "coefficient_stability": (coefficient_stability, _STABILITY),
    "coxnet_grid": (coxnet_grid, None),
    "coxnet_certificates": (coxnet_certificates, _CERTIFICATES),
    "final_plan": (final_plan, _FINAL_PLAN),
    "final_certificates": (final_certificates, _FINAL_CERTIFICATES),
    "final_model": (final_model, None),
    "permutation_importance": (
        permutation_importance,
        f"{_DROPS} SELECT repeat, fold, gene, permutation, {r('c_drop')} AS c_drop FROM drops",
    ),
    "importance_rollup": (importance_rollup, _ROLLUP),
    "importance_rank_corr": (importance_rank_corr, _RANK),
}
