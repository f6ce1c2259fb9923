"""Registered queries: cohort-relative scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortforge.catalogue.base_sql import X1, r, signature_values
from cohortforge.functions.numeric import round_at
from cohortforge.operators import scoring
from cohortforge.plans import standins


def _scores(df: DataFrame) -> DataFrame:
    return df.select("cohort_id", "signature", "sample_id", round_at(F.col("score")).alias("score"))


def score_rowmean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rowmean scores of every unweighted signature."""
    sig = standins.signatures(spark).filter(F.col("scoring") == "rowmean")
    return _scores(scoring.score_rowmean(standins.expression(spark, sf_dir), sig))


def score_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(
        scoring.score_weighted(standins.expression(spark, sf_dir), standins.signatures(spark))
    )


def score_median_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    sig = standins.signatures(spark).filter(F.col("signature") == "s20")
    return _scores(scoring.score_median_z(standins.expression(spark, sf_dir), sig))


def score_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.coverage(standins.expression(spark, sf_dir), standins.signatures(spark))
    return found.select(
        "cohort_id",
        "signature",
        "n_found",
        "n_total",
        round_at(F.col("coverage")).alias("coverage"),
        F.array_join("missing", ",").alias("missing"),
        F.col("refused").cast("int").alias("refused"),
    )


def score_batch_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches are segment times nation; small ones are listed as refused."""
    genes = standins.signature_genes("s20")
    nations = standins.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("sample_id"), "c_nationkey"
    )
    matrix = standins.expression(spark, sf_dir, genes).join(nations, "sample_id").withColumn(
        "batch_id", F.concat_ws("/", "cohort_id", "c_nationkey")
    )
    sig = standins.signatures(spark).filter(F.col("signature") == "s20")
    scores, sizes = scoring.score_batches(matrix, sig)
    means = scores.groupBy("batch_id").agg(
        round_at(F.avg("score")).alias("mean_score"), round_at(F.max("score")).alias("max_score")
    )
    return sizes.join(means, "batch_id", "left").select(
        "batch_id", "n_samples", F.col("refused").cast("int").alias("refused"), "mean_score", "max_score"
    )


_USABLE = f"""
WITH {signature_values()}, {X1},
cells AS (SELECT x1.*, signature, coefficient, scoring FROM x1 JOIN sig USING (gene)),
stats AS (SELECT cohort_id, signature, gene, avg(value) AS m, stddev_samp(value) AS s FROM cells GROUP BY 1, 2, 3),
enough AS (SELECT cohort_id, signature FROM stats GROUP BY 1, 2 HAVING count(*) >= 3),
z AS (SELECT cohort_id, signature, sample_id, gene, scoring, coefficient, value,
             CASE WHEN s <> 0 THEN (value - m) / s END AS z
      FROM cells JOIN stats USING (cohort_id, signature, gene) JOIN enough USING (cohort_id, signature)),
pop AS (SELECT DISTINCT cohort_id, sample_id FROM x1)"""


def _finish(where: str, score: str) -> str:
    return f"""{_USABLE},
picked AS (SELECT * FROM z WHERE {where}),
groups AS (SELECT DISTINCT cohort_id, signature FROM picked)
SELECT cohort_id, signature, sample_id, {r(score)} AS score
FROM pop JOIN groups USING (cohort_id) LEFT JOIN picked USING (cohort_id, signature, sample_id)
GROUP BY 1, 2, 3"""


_MEDIAN = f"""{_USABLE},
med AS (SELECT cohort_id, signature, sample_id, median(value) AS md FROM z WHERE signature = 's20' GROUP BY 1, 2, 3),
spread AS (SELECT cohort_id, signature, avg(md) AS m, stddev_samp(md) AS s FROM med GROUP BY 1, 2)
SELECT cohort_id, signature, sample_id, {r('(md - m) / nullif(s, 0)')} AS score
FROM pop JOIN spread USING (cohort_id) LEFT JOIN med USING (cohort_id, signature, sample_id)"""

_COVERAGE = f"""
WITH {signature_values()}, {X1},
present AS (SELECT DISTINCT cohort_id, gene FROM x1),
pairs AS (SELECT c.cohort_id, sig.signature, sig.gene, present.gene IS NOT NULL AS found
          FROM (SELECT DISTINCT cohort_id FROM present) c CROSS JOIN sig
          LEFT JOIN present ON present.cohort_id = c.cohort_id AND present.gene = sig.gene)
SELECT cohort_id, signature, count(*) FILTER (found) AS n_found, count(*) AS n_total,
       {r('count(*) FILTER (found) * 1e0 / count(*)')} AS coverage,
       coalesce(string_agg(gene, ',' ORDER BY gene) FILTER (NOT found), '') AS missing,
       CAST(count(*) FILTER (found) < 3 AS INTEGER) AS refused
FROM pairs GROUP BY 1, 2"""

_BATCH = f"""
WITH {signature_values()}, {X1},
m AS (SELECT cohort_id || '/' || CAST(c_nationkey AS VARCHAR) AS batch_id, gene, sample_id, value
      FROM x1 JOIN customer ON sample_id = CAST(c_custkey AS VARCHAR)
      WHERE gene IN (SELECT gene FROM sig WHERE signature = 's20')),
sizes AS (SELECT batch_id, count(DISTINCT sample_id) AS n_samples FROM m GROUP BY 1),
kept AS (SELECT m.* FROM m JOIN sizes USING (batch_id) WHERE n_samples >= 20),
stats AS (SELECT batch_id, gene, avg(value) AS mu, stddev_samp(value) AS sd FROM kept GROUP BY 1, 2),
sc AS (SELECT batch_id, sample_id, avg(CASE WHEN sd <> 0 THEN (value - mu) / sd END) AS score
       FROM kept JOIN stats USING (batch_id, gene) GROUP BY 1, 2)
SELECT batch_id, any_value(n_samples) AS n_samples, CAST(any_value(n_samples) < 20 AS INTEGER) AS refused,
       {r('avg(score)')} AS mean_score, {r('max(score)')} AS max_score
FROM sizes LEFT JOIN sc USING (batch_id) GROUP BY 1"""

QUERIES = {
    "score_rowmean": (score_rowmean, _finish("scoring = 'rowmean'", "avg(z)")),
    "score_weighted": (
        score_weighted,
        _finish("coefficient IS NOT NULL", "coalesce(sum(coefficient * z), 0e0)"),
    ),
    "score_median_z": (score_median_z, _MEDIAN),
    "score_coverage": (score_coverage, _COVERAGE),
    "score_batch_floor": (score_batch_floor, _BATCH),
}
