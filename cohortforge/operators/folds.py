"""Stratified repeated nested fold plans, decided by digests instead of a generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortforge.operators.ordering import hashed_position


def _digest(*parts) -> Column:
    return F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def plan_problems(samples: DataFrame, outer: int, inner: int, by: str = "cohort_id") -> DataFrame:
    """Cohorts whose smaller outcome class cannot fill the folds."""
    smallest = samples.groupBy(by).agg(
        F.least(F.count_if(F.col("event") == 1), F.count_if(F.col("event") == 0)).alias("smallest_class")
    )
    train = F.col("smallest_class") - F.ceil(F.col("smallest_class") / outer)
    code = F.when(F.col("smallest_class") < 2 * outer, "too_few_for_outer_folds").when(
        train < inner, "too_few_for_inner_folds"
    )
    return smallest.withColumn("problem", code).filter(F.col("problem").isNotNull())


def test_folds(
    samples: DataFrame, outer: int = 5, repeats: int = 5, seed: int = 902001, by: str = "cohort_id"
) -> DataFrame:
    """The held-out side of the plan: one (repeat, fold) per sample and repeat.

    Ranks are taken per outcome class in digest order, so folds are stratified,
    and the plan is the same wherever and whenever it is evaluated.
    """
    refused = plan_problems(samples, outer, 2, by).select(by)
    usable = samples.select(by, "sample_id", "event").join(refused, by, "left_anti")
    repeated = usable.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).withColumn(
        "_d", _digest(seed, F.col("repeat"), F.col("sample_id"))
    )
    placed = hashed_position(repeated, [by, "repeat", "event"], "_d", "sample_id", "_pos")
    return placed.select(
        by, "repeat", ((F.col("_pos") - 1) % outer + 1).cast("int").alias("fold"), "sample_id", "event"
    )


def plan(
    samples: DataFrame,
    outer: int = 5,
    inner: int = 5,
    repeats: int = 5,
    seed: int = 902001,
    by: str = "cohort_id",
) -> DataFrame:
    """(cohort, repeat, fold, inner_fold, sample_id, event, role) rows.

    Within each repeat every sample is the test of exactly one fold; training
    rows carry the inner fold in which they validate, test rows carry 0.
    """
    if min(outer, inner) < 2 or repeats < 1:
        raise ValueError("need at least two folds and one repeat")
    refused = plan_problems(samples, outer, inner, by).select(by)
    tested = test_folds(samples, outer, repeats, seed, by).join(refused, by, "left_anti")
    held = tested.withColumn("inner_fold", F.lit(0)).withColumn("role", F.lit("test"))
    train = (
        tested.withColumnRenamed("fold", "_test")
        .withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(outer))))
        .filter(F.col("fold") != F.col("_test"))
        .withColumn("_d", _digest(seed, F.col("repeat"), F.col("fold"), F.col("sample_id")))
        .withColumn("role", F.lit("train"))
    )
    numbered = hashed_position(
        train, [by, "repeat", "fold", "event"], "_d", "sample_id", "_pos"
    ).withColumn("inner_fold", ((F.col("_pos") - 1) % inner + 1).cast("int"))
    columns = [by, "repeat", "fold", "inner_fold", "sample_id", "event", "role"]
    return numbered.select(*columns).unionByName(held.select(*columns))


def whole_plan(samples: DataFrame, inner: int = 3, seed: int = 902001, by: str = "cohort_id") -> DataFrame:
    """Rows of ``plan``'s form for a final fit: everyone trains; the inner folds are plain, not stratified.

    There is one repeat and fold per cohort. Places are taken in digest order, so inner folds differ by one sample at
    most; a cohort of fewer samples than folds leaves some empty.
    """
    if inner < 2:
        raise ValueError("need at least two folds")
    drawn = samples.select(by, "sample_id", "event").withColumn("_d", _digest(seed, F.col("sample_id")))
    placed = hashed_position(drawn, [by], "_d", "sample_id", "_pos")
    number = ((F.col("_pos") - 1) % inner + 1).cast("int").alias("inner_fold")
    one = F.lit(1)
    return placed.select(by, one.alias("repeat"), one.alias("fold"), number, "sample_id", "event", F.lit("train").alias("role"))


def plan_violations(plan_rows: DataFrame, by: str = "cohort_id") -> DataFrame:
    """Samples not tested exactly once per repeat, or listed twice in a fold."""
    per_fold = plan_rows.groupBy(by, "repeat", "fold", "sample_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("role") == "test").alias("_t")
    )
    return (
        per_fold.groupBy(by, "repeat", "sample_id")
        .agg(F.max("_n").alias("max_rows_per_fold"), F.sum("_t").alias("n_test_folds"))
        .filter((F.col("max_rows_per_fold") > 1) | (F.col("n_test_folds") != 1))
    )
