"""Development comparison: one fold plan shared by all models, then the summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortforge.functions.staging import written
from cohortforge.functions.text import ADJUDICATION_DAYS_PER_MONTH
from cohortforge.operators import crossval, folds, resample
from cohortforge.operators.adjudication import CAP_MONTHS

MONTH_TOLERANCE = 1e-12


def locked_problems(clinical: DataFrame, verdicts: DataFrame, pinned: DataFrame) -> DataFrame:
    """Differences between a cohort's clinical table, its ledger and its pinned counts.

    ``clinical`` has (sample_id, time_days, time_months, event_uncapped, event),
    ``verdicts`` the adjudication rows, ``pinned`` one row (n, n_uncapped, n_events).
    """
    ledger = verdicts.select(
        F.col("patient").alias("sample_id"), F.col("included").alias("_in"), F.col("time_days").alias("_d"),
        F.col("event_uncapped").alias("_u"), F.col("event").alias("_e"),
    )
    months = F.least(F.col("time_days") / ADJUDICATION_DAYS_PER_MONTH, F.lit(CAP_MONTHS))
    row_code = (
        F.when(~F.coalesce("_in", F.lit(False)) | ~F.col("_d").eqNullSafe(F.col("time_days")), "ledger_day")
        .when(~(F.col("_u").eqNullSafe(F.col("event_uncapped")) & F.col("_e").eqNullSafe(F.col("event"))), "ledger_event")
        .when(F.abs(F.col("time_months") - months) > MONTH_TOLERANCE, "month_derivation")
    )
    rows = clinical.join(ledger, "sample_id", "left").withColumn("problem", row_code)
    per_row = rows.filter(F.col("problem").isNotNull()).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))
    totals = clinical.agg(
        F.count(F.lit(1)).alias("_n"), F.sum("event_uncapped").alias("_u"), F.sum("event").alias("_e")
    )
    want = pinned.agg(F.first(F.struct("n", "n_uncapped", "n_events"))).scalar()
    counts = totals.withColumn("_w", want).filter(
        (F.col("_n") != F.col("_w.n")) | (F.col("_u") != F.col("_w.n_uncapped")) | (F.col("_e") != F.col("_w.n_events"))
    ).select(F.lit("pinned_counts").alias("problem"), F.col("_n").alias("n"))
    return per_row.unionByName(counts)


def compare_models(
    matrix: DataFrame,
    outcomes: DataFrame,
    genes: list[str],
    grid: DataFrame,
    outer: int = 5,
    inner: int = 5,
    repeats: int = 5,
    draws: int = 2000,
) -> dict[str, DataFrame]:
    """Fixed-composite and elastic-net Cox on the same folds, with paired intervals."""
    plan = written(folds.plan(outcomes, outer, inner, repeats), "plan")
    fixed = crossval.fixed_signature_cv(matrix, outcomes, plan)
    net = crossval.penalised_cv(matrix, outcomes, plan, genes, grid, inner)
    columns = ["repeat", "fold", "sample_id", "time_months", "event", "risk"]
    held = written(
        fixed["predictions"].select(F.lit("fixed_cox").alias("model"), *columns).unionByName(
            net["predictions"].select(F.lit("elastic_net").alias("model"), *columns)
        ),
        "held-out",
    )
    problems = resample.prediction_problems(held).limit(5).collect()
    if problems:
        raise ValueError("predictions are not paired: " + ", ".join(p["problem"] for p in problems))
    comparison, differences = resample.paired_bootstrap(held, draws)
    return {
        "plan": plan,
        "predictions": held,
        "search": net["search"],
        "coefficients": net["coefficients"],
        "stability": resample.coefficient_stability(net["coefficients"]),
        "comparison": comparison,
        "differences": differences,
        "folds": resample.fold_concordance(held),
    }


def gather_results(tables: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """Result tables of (cohort, action) runs as one table, missing columns as NULL."""
    out = None
    for (cohort, action), table in sorted(tables.items()):
        part = table.withColumn("cohort", F.lit(cohort)).withColumn("action", F.lit(action))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no result tables")
    return out.orderBy("cohort", "action")
