"""Leak-free cross-validation: folds are keys, not a loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortforge.functions.numeric import finite, ratio
from cohortforge.functions.staging import written
from cohortforge.operators import cox, fold_blocks, net_path, scaler
from cohortforge.operators.concordance import harrell


def contract_problems(matrix: DataFrame, outcomes: DataFrame, genes: list[str], by: str = "cohort_id") -> DataFrame:
    """Violations of the feature contract: missing genes, missing or non-finite values, id mismatch."""
    required = matrix.filter(F.col("gene").isin(genes))
    samples = matrix.groupBy(by, "sample_id").agg(
        F.count_if(F.col("gene").isin(genes) & finite(F.col("value"))).alias("_ok"),
        F.count_if(F.col("gene").isin(genes)).alias("_rows"),
    )
    listed = outcomes.groupBy(by, "sample_id").agg(F.count(F.lit(1)).alias("_o"))
    both = samples.join(listed, [by, "sample_id"], "full_outer")
    code = (
        F.when(F.col("_o").isNull(), "sample_without_outcome")
        .when(F.col("_rows").isNull(), "outcome_without_sample")
        .when((F.col("_o") > 1) | (F.col("_rows") > len(genes)), "duplicate_labels")
        .when(F.col("_ok") < len(genes), "missing_or_nonfinite_value")
    )
    per_sample = both.withColumn("problem", code).filter(F.col("problem").isNotNull()).groupBy(by, "problem").agg(
        F.count(F.lit(1)).alias("n")
    )
    present = required.select(by, "gene").distinct().groupBy(by).agg(F.count(F.lit(1)).alias("_g"))
    lacking = (
        matrix.select(by).distinct().join(present, by, "left")
        .withColumn("n", len(genes) - F.coalesce("_g", F.lit(0)))
        .filter(F.col("n") > 0)
        .select(by, F.lit("missing_required_genes").alias("problem"), "n")
    )
    return per_sample.unionByName(lacking)


def cells_of(matrix: DataFrame, roles: DataFrame) -> DataFrame:
    """Matrix cells of every sample with a role, matched within its own cohort."""
    on = [c for c in roles.columns if c in matrix.columns and c not in ("gene", "value")]
    return matrix.select(*on, "gene", "value").join(roles, on)


def partition_scores(
    matrix: DataFrame, roles: DataFrame, keys: list[str], fit_on: tuple[str, ...] = ("train",)
) -> DataFrame:
    """Standardise every partition by its own training rows only.

    ``roles`` has (keys, sample_id, role, ...) with roles ``train`` and ``test``;
    the result adds ``raw`` (mean frozen z) and ``score`` (the composite, scaled
    by the training composite's mean and sd).  Partitions with a constant
    training gene or composite are left out (see ``partition_problems``).
    ``fit_on`` other than the training rows is a leak; it serves as the negative
    control of ``leakage``.
    """
    cells = cells_of(matrix, roles.select(*keys, "sample_id", "role"))
    fitted = written(scaler.fit(cells.filter(F.col("role").isin(*fit_on)), keys), "cv-scaler")
    bad = scaler.degenerate_genes(fitted, keys).select(*keys).distinct()
    good = fitted.join(bad, keys, "left_anti")
    raw = (
        cells.join(good.select(*keys, "gene", "mean", "sd"), [*keys, "gene"])
        .groupBy(*keys, "sample_id", "role")
        .agg(F.avg((F.col("value") - F.col("mean")) / F.col("sd")).alias("raw"))
    )
    raw = written(raw, "cv-raw")
    composite = raw.filter(F.col("role").isin(*fit_on)).groupBy(*keys).agg(
        F.avg("raw").alias("composite_mean"), F.stddev_samp("raw").alias("composite_sd")
    ).filter(F.col("composite_sd") > scaler.MIN_SD)
    return raw.join(composite, keys).withColumn(
        "score", (F.col("raw") - F.col("composite_mean")) / F.col("composite_sd")
    )


def partition_problems(matrix: DataFrame, roles: DataFrame, keys: list[str]) -> DataFrame:
    """Partitions that cannot be fitted: a training gene without spread."""
    cells = cells_of(matrix, roles.filter(F.col("role") == "train").select(*keys, "sample_id"))
    return scaler.degenerate_genes(scaler.fit(cells, keys), keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_constant_genes")
    )


def leakage(
    matrix: DataFrame,
    roles: DataFrame,
    keys: list[str],
    shift: float = 1000.0,
    fit_on: tuple[str, ...] = ("train",),
) -> DataFrame:
    """Whether held-out values reach the training scores, per partition.

    Runs the cross-validation path twice, once with every second held-out cell moved by ``shift``,
    and compares the training rows' scores: (keys, n_train, unchanged).
    """
    test = roles.filter(F.col("role") == "test").select(*keys, "sample_id", F.lit(shift).alias("_shift"))
    on = [c for c in test.columns if c in matrix.columns]
    odd = F.pmod(F.xxhash64("sample_id"), F.lit(2)).cast("double")
    moved = matrix.join(test.select(*on, "_shift").distinct(), on, "left").withColumn(
        "value", F.col("value") + F.coalesce("_shift", F.lit(0.0)) * odd
    ).drop("_shift")
    # The shifted matrix must hold the training values of the partition it is compared on.
    plain = partition_scores(matrix, roles, keys, fit_on).filter(F.col("role") == "train")
    other = partition_scores(moved, roles, keys, fit_on).filter(F.col("role") == "train")
    both = plain.select(*keys, "sample_id", F.col("score").alias("_a")).join(
        other.select(*keys, "sample_id", F.col("score").alias("_b")), [*keys, "sample_id"]
    )
    return both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_train"), (F.max(F.abs(F.col("_a") - F.col("_b"))) < 1e-9).alias("unchanged")
    )


def fold_scalers(matrix: DataFrame, tested: DataFrame, by: str = "cohort_id") -> DataFrame:
    """Scaler of every fold's training side: (by, repeat, fold, gene, mean, sd, n_fit).

    ``tested`` has one (by, repeat, fold, sample_id) row per sample and repeat; a fold trains on the samples of its
    repeat's other folds. Moments are those of the whole repeat less the test fold's, taken by blocks of samples in which
    a sample is one row. They are about the gene's cohort mean, which keeps the differences exact.
    A spread under ``MIN_SD`` is null; folds with fewer than two training samples have no scaler.
    """
    genes = _genes(matrix)
    rows = fold_blocks.held_rows(matrix, tested, genes, ["repeat"], "fold", by)
    centre = matrix.groupBy(by, "gene").agg(F.avg("value").alias("_c"))
    fitted = _part_scalers(rows, tested, genes, ["repeat"], "fold", by)
    return fitted.join(centre, [by, "gene"]).select(by, "repeat", "fold", "gene", (F.col("_c") + F.col("mean")).alias("mean"), "sd", "n_fit")


def _genes(matrix: DataFrame) -> list[str]:
    """The signature's genes: a small dimension."""
    return sorted(r[0] for r in matrix.select("gene").distinct().collect())


def _part_scalers(rows: DataFrame, held: DataFrame, genes: list[str], group: list[str], part: str, by: str) -> DataFrame:
    """(by, group, part, gene, mean, sd, n_fit) of what a part trains on: its group's other samples. Means are less the cohort's."""
    moments = fold_blocks.part_moments(rows, held, genes, group, part, by)
    whole = moments.groupBy(by, *group, "gene").agg(F.sum("n").alias("_n"), F.sum("s1").alias("_s1"), F.sum("s2").alias("_s2"))
    sizes = held.groupBy(by, *group, part).agg(F.count(F.lit(1)).alias("_size"))
    total = sizes.groupBy(by, *group).agg(F.sum("_size").alias("_all"))
    fits = sizes.join(total, [by, *group]).select(by, *group, part, (F.col("_all") - F.col("_size")).alias("n_fit"))
    left = whole.join(fits.filter("n_fit >= 2"), [by, *group]).join(moments, [by, *group, "gene", part], "left")
    zero = F.lit(0)
    n = F.col("_n") - F.coalesce("n", zero)
    s1, s2 = F.col("_s1") - F.coalesce("s1", zero), F.col("_s2") - F.coalesce("s2", zero)
    mean = ratio(s1, n)
    sd = F.sqrt(F.greatest(s2 - s1 * mean, F.lit(0.0)) / (n - 1))
    return left.filter(n > 0).select(
        by, *group, part, "gene", mean.alias("mean"), F.when((n > 1) & (sd >= scaler.MIN_SD), sd).alias("sd"), "n_fit"
    )


def fold_scores(
    matrix: DataFrame, plan: DataFrame, by: str = "cohort_id", outcomes: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Composite scores of every (by, repeat, fold, sample_id, role), and the folds with constant genes.

    As ``partition_scores`` with ``fold_scalers``: a sample's genes are one row of a block, which meets the means and spreads of its folds;
    only the score is held per fold, with ``time_months`` and ``event`` of ``outcomes`` if given.
    """
    keys = [by, "repeat", "fold"]
    tested = plan.filter(F.col("role") == "test").select(*keys, "sample_id")
    genes = _genes(matrix)
    rows = fold_blocks.held_rows(matrix, tested, genes, ["repeat"], "fold", by)
    fitted = written(_part_scalers(rows, tested, genes, ["repeat"], "fold", by), "fold-scalers")
    if outcomes is not None:
        # Everyone in the plan and the matrix was fitted on, with an outcome or not.
        rows = rows.join(outcomes.select(by, "sample_id", "time_months", "event"), [by, "sample_id"])
    constant = written(
        scaler.degenerate_genes(fitted, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_constant_genes")), "fold-constant"
    )
    good = written(fitted.join(constant, keys, "left_anti"), "fold-good")
    raw = fold_blocks.part_scores(rows, good, genes, [genes], ["repeat"], "fold", by, False)
    role = F.when(F.col("_held"), "test").otherwise("train").alias("role")
    outcome = [c for c in ("time_months", "event") if c in rows.columns]
    raw = written(raw.select(*keys, "sample_id", *outcome, role, F.col("_r")[0].alias("raw")), "cv-raw")
    composite = written(raw.filter(F.col("role") == "train").groupBy(*keys).agg(
        F.avg("raw").alias("composite_mean"), F.stddev_samp("raw").alias("composite_sd")
    ).filter(F.col("composite_sd") > scaler.MIN_SD), "cv-composite")
    scored = raw.filter(F.col("raw").isNotNull()).join(composite, keys)
    return scored.withColumn("score", (F.col("raw") - F.col("composite_mean")) / F.col("composite_sd")), constant


def composite_search(
    matrix: DataFrame, outcomes: DataFrame, plan: DataFrame, sets: dict[int, list[str]], by: str = "cohort_id"
) -> DataFrame:
    """Inner C of composites of gene sets: (by, repeat, fold, inner_fold, candidate, comparable_pairs, c_index).

    ``sets`` has the genes of every candidate. An inner fold's scaler is that of the outer training set's other samples. A sample
    is one row of a block with the inner folds that hold it out; it has a risk per candidate there and travels no further.
    """
    group, part = ["repeat", "fold"], "inner_fold"
    held = plan.filter(F.col("role") == "train").select(by, *group, part, "sample_id")
    genes = _genes(matrix)
    rows = fold_blocks.held_rows(matrix, held, genes, group, part, by)
    fitted = written(_part_scalers(rows, held, genes, group, part, by), "inner-scalers")
    rows = rows.join(outcomes.select(by, "sample_id", "time_months", "event"), [by, "sample_id"])
    numbers = sorted(sets)
    risks = fold_blocks.part_scores(rows, fitted, genes, [sets[c] for c in numbers], group, part, by, True)
    known = F.col("time_months").isNotNull() & F.col("event").isNotNull()
    risks = risks.filter(known).select(
        by, *group, part, F.col("time_months").cast("double").alias("_t"), F.col("event").cast("int").alias("_e"), F.col("_r").alias("risks")
    )
    found = net_path.risk_concordance(risks, by, len(numbers))
    candidate = F.array(*[F.lit(c) for c in numbers])[F.col("place")]
    return found.select(by, *group, part, candidate.alias("candidate"), F.col("comparable").cast("long").alias("comparable_pairs"), "c_index")


def fixed_signature_cv(
    matrix: DataFrame, outcomes: DataFrame, plan: DataFrame, by: str = "cohort_id"
) -> dict[str, DataFrame]:
    """Outer cross-validation of the fixed-composite Cox model.

    Returns ``folds``, ``predictions`` and ``scaler`` tables.  ``matrix`` holds
    the signature genes only; ``outcomes`` has (cohort, sample_id, time_months,
    event).  ``plan`` tests every sample once per repeat and trains on the other folds (``folds.plan``).
    ``folds`` has a row for every planned fold; one that could not be fitted
    or scored says why in ``error``.
    """
    keys = [by, "repeat", "fold"]
    roles = plan.select(*keys, "sample_id", "role")
    scored, constant = fold_scores(matrix, roles, by, outcomes)
    train, test = scored.filter(F.col("role") == "train"), scored.filter(F.col("role") == "test")
    models = written(cox.fit(train, keys, ["score"]), "cv-models").filter("converged").select(
        *keys, F.col("beta")[0].alias("coefficient")
    )
    predictions = test.join(models, keys).select(
        *keys, "sample_id", "time_months", "event", (F.col("coefficient") * F.col("score")).alias("risk")
    )
    sizes = scored.groupBy(*keys).agg(
        F.count_if(F.col("role") == "train").alias("n_train"),
        F.count_if(F.col("role") == "test").alias("n_test"),
        F.count_if((F.col("role") == "test") & (F.col("event") == 1)).alias("n_test_events"),
    )
    error = (
        F.when(F.col("n_constant_genes") > 0, "constant_training_gene")
        .when(F.col("n_train").isNull(), "no_usable_composite")
        .when(F.col("coefficient").isNull(), "not_converged")
        .when(F.col("c_index").isNull(), "no_comparable_pairs")
    )
    folds = (
        roles.select(*keys).distinct()
        .join(sizes, keys, "left")
        .join(models, keys, "left")
        .join(harrell(predictions, keys).select(*keys, "comparable_pairs", "c_index"), keys, "left")
        .join(constant, keys, "left")
        .withColumn("error", error)
        .drop("n_constant_genes")
    )
    frozen = scored.groupBy(*keys).agg(
        F.first("composite_mean").alias("composite_mean"), F.first("composite_sd").alias("composite_sd")
    )
    return {"folds": folds, "predictions": predictions, "scaler": frozen}


def select_candidates(
    inner: DataFrame, keys: list[str], n_inner: int, require_all: bool = True
) -> DataFrame:
    """Best candidate per key by mean inner C; ties go to the lowest candidate number.

    ``inner`` has (keys, candidate, inner_fold, c_index).  With ``require_all``
    a candidate must have a score in every inner fold; the lenient form averages
    whatever folds could be scored.
    """
    means = inner.groupBy(*keys, "candidate").agg(
        F.avg("c_index").alias("mean_c"), F.count("c_index").alias("n_scored")
    )
    valid = means.filter(F.col("n_scored") == n_inner) if require_all else means.filter(F.col("n_scored") > 0)
    return valid.groupBy(*keys).agg(
        F.min_by(F.struct("candidate", "mean_c"), F.struct(-F.col("mean_c"), F.col("candidate"))).alias("_b")
    ).select(*keys, "_b.candidate", "_b.mean_c")


def inner_partitions(plan: DataFrame, n_inner: int, by: str = "cohort_id") -> DataFrame:
    """Inner train / validation roles of every outer training set, as keyed rows."""
    train = plan.filter(F.col("role") == "train").withColumnRenamed("inner_fold", "_own")
    return train.withColumn("inner_fold", F.explode(F.sequence(F.lit(1), F.lit(n_inner)))).select(
        by,
        "repeat",
        "fold",
        "inner_fold",
        "sample_id",
        F.when(F.col("inner_fold") == F.col("_own"), "test").otherwise("train").alias("role"),
    )


def penalised_cv(
    matrix: DataFrame,
    outcomes: DataFrame,
    plan: DataFrame,
    genes: list[str],
    grid: DataFrame,
    n_inner: int,
    by: str = "cohort_id",
    require_all: bool = True,
    min_validation_events: int = 0,
) -> dict[str, DataFrame]:
    """Nested cross-validation of the elastic-net Cox grid.

    ``grid`` has (candidate, alpha, l1_ratio), a list of settings. All inner and outer partitions are fitted
    together, see ``net_path``. Returns

    - ``search``: a row for every planned inner fold and candidate: ``n_train, n_events, residual`` (of the optimality
      conditions), ``rounds, c_index`` and ``error`` (``no_training_events``, ``not_converged``,
      ``too_few_validation_events``, ``no_comparable_pairs``, or null);
    - ``selected``: the best candidate of each outer fold that has one;
    - ``coefficients``: those of the outer refits;
    - ``predictions``: held-out risks of the selected candidates;
    - ``folds``: a row for every planned outer fold with ``candidate, residual, comparable_pairs, c_index`` and ``error``
      (``no_usable_candidate`` besides those above).
    """
    listed = [(r["candidate"], float(r["alpha"]), float(r["l1_ratio"])) for r in grid.orderBy("candidate").collect()]
    rows = net_path.member_rows(matrix, outcomes, plan, genes, by)
    state = net_path.fit_paths(rows, listed, n_inner, by)
    keys, outer_keys = [by, *net_path.PART], [by, "repeat", "fold"]
    held = written(net_path.held_risks(rows, state, by, len(listed)), "net-held")
    scored = written(net_path.risk_concordance(held, by, len(listed)), "net-concordance")
    number = F.array(*[F.lit(c) for c, _, _ in listed])
    fits = state.select(
        *keys, F.col("n").alias("n_train"), F.col("events").alias("n_events"), F.posexplode(F.arrays_zip("done", "residual", "rounds")).alias("place", "_f")
    ).select(*keys, "place", number[F.col("place")].alias("candidate"), "n_train", "n_events", "_f.*")
    fits = written(fits.join(scored, [*keys, "place"], "left"), "net-fits")
    error = (
        F.when(F.col("n_events") == 0, "no_training_events")
        .when(F.col("done") == 0, "not_converged")
        .when(F.coalesce("held_events", F.lit(0)) < min_validation_events, "too_few_validation_events")
        .when(F.col("c_index").isNull(), "no_comparable_pairs")
    )
    residual = F.when(F.col("n_events") > 0, F.col("residual")).alias("residual")
    search = fits.filter(F.col("inner_fold") > 0).withColumn("error", error).select(
        *keys, "candidate", "n_train", "n_events", residual, F.col("rounds").cast("int").alias("rounds"),
        F.when(F.col("error").isNull(), F.col("c_index")).alias("c_index"), "error",
    )
    search = written(search, "net-search")
    chosen = written(select_candidates(search, outer_keys, n_inner, require_all).join(grid, "candidate"), "net-chosen")
    outer = fits.filter(F.col("inner_fold") == 0).join(chosen.select(*outer_keys, "candidate"), [*outer_keys, "candidate"])
    folds = (
        state.filter(F.col("inner_fold") == 0).select(*outer_keys)
        .join(outer.withColumn("error", error), outer_keys, "left")
        .select(
            *outer_keys, "candidate", residual, F.col("comparable").cast("long").alias("comparable_pairs"), "c_index",
            F.when(F.col("candidate").isNull(), "no_usable_candidate").otherwise(F.col("error")).alias("error"),
        )
    )
    good = outer.filter(F.col("done") > 0).select(*outer_keys, "place")
    weights = state.filter(F.col("inner_fold") == 0).join(good, outer_keys)
    own = F.slice("beta", F.col("place") * len(genes) + 1, len(genes))
    coefficients = weights.select(*outer_keys, F.posexplode(own).alias("_a", "coefficient")).select(
        *outer_keys, F.array(*[F.lit(g) for g in genes])[F.col("_a")].alias("feature"), "coefficient"
    )
    predictions = held.filter(F.col("inner_fold") == 0).join(good, outer_keys).select(
        *outer_keys, "sample_id", F.col("_t").alias("time_months"), F.col("_e").alias("event"), F.col("risks")[F.col("place")].alias("risk")
    )
    return {
        "search": search,
        "selected": chosen,
        "coefficients": coefficients,
        "predictions": predictions,
        "folds": written(folds, "net-folds"),
    }


def fit_final(
    matrix: DataFrame,
    outcomes: DataFrame,
    plan: DataFrame,
    genes: list[str],
    grid: DataFrame,
    n_inner: int,
    by: str = "cohort_id",
    min_validation_events: int = 2,
) -> dict[str, DataFrame]:
    """The elastic-net model to deploy for each cohort: penalty by plain cross-validation, then a fit to all its samples.

    ``plan`` is a ``folds.whole_plan``, ``grid`` as in ``penalised_cv``. Inner folds with fewer than
    ``min_validation_events`` events and fits that failed are left out of a candidate's mean; of equal means the lowest
    candidate wins. The searches and final fits of all cohorts run together. Returns

    - ``search``: as of ``penalised_cv``;
    - ``model``: a row for every cohort of the plan with ``n_train, n_events, candidate, alpha, l1_ratio, mean_c, n_scored,
      n_selected, residual`` and ``error`` (``no_usable_candidate``, ``not_converged`` or null);
    - ``scaler``: ``gene, mean, sd, n_fit`` of all samples, to be frozen with the model;
    - ``coefficients``: ``feature, coefficient`` of models without error. ``apply_model`` takes both.

    The search's means choose a penalty; they are no estimate of how well the model does, nor is its fit to these samples.
    """
    planned = plan.select(by, "sample_id", "event")
    out = penalised_cv(matrix, outcomes, plan, genes, grid, n_inner, by, False, min_validation_events)
    folded = out["folds"].select(by, "candidate", "residual")
    scored = out["search"].filter(F.col("error").isNull()).groupBy(by, "candidate").agg(F.count(F.lit(1)).alias("n_scored"))
    sizes = planned.groupBy(by).agg(F.count(F.lit(1)).alias("n_train"), F.count_if(F.col("event") == 1).alias("n_events"))
    coefficients = written(out["coefficients"].select(by, "feature", "coefficient"), "final-coefficients")
    used = coefficients.groupBy(by).agg(F.count_if(F.col("coefficient") != 0).alias("n_selected"))
    error = F.when(F.col("candidate").isNull(), "no_usable_candidate").when(F.col("n_selected").isNull(), "not_converged")
    model = (
        sizes.join(folded, by, "left")
        .join(out["selected"].select(by, "candidate", "alpha", "l1_ratio", "mean_c"), [by, "candidate"], "left")
        .join(scored, [by, "candidate"], "left")
        .join(used, by, "left")
        .select(
            by, "n_train", "n_events", "candidate", "alpha", "l1_ratio", "mean_c", "n_scored", "n_selected", "residual", error.alias("error")
        )
    )
    cells = matrix.filter(F.col("gene").isin(genes)).join(planned.select(by, "sample_id"), [by, "sample_id"], "left_semi")
    return {
        "search": out["search"],
        "model": written(model, "final-model"),
        "scaler": scaler.fit(cells, [by]),
        "coefficients": coefficients,
    }


def apply_model(
    matrix: DataFrame, model_scaler: DataFrame, coefficients: DataFrame, keys: list[str]
) -> DataFrame:
    """Linear predictor of a fitted model on another cohort, with the model's own scaler."""
    z = scaler.transform(matrix, model_scaler, keys)
    weights = coefficients.select(*keys, F.col("feature").alias("gene"), "coefficient")
    return z.join(weights, [*keys, "gene"]).groupBy(*keys, "sample_id").agg(
        F.sum(F.col("z") * F.col("coefficient")).alias("risk")
    )
