"""Registered queries: file streams, whole cohort builds and file verification."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortforge.catalogue.base_sql import X1, X2, X6, alias_values, r
from cohortforge.catalogue.endpoint_queries import RULES, specs
from cohortforge.catalogue.survival_queries import MODEL_GENES, _model, _requests, _rounded
from cohortforge.catalogue import survival_queries as sq
from cohortforge.functions.staging import shared_folder, written
from cohortforge.operators import provenance, scaler
from cohortforge.plans import cohort_build, standins
from cohortforge.streaming import frozen, sinks

SAMPLE_SCHEMA = "sample_id string, expression_type string, expr map<string,double>"
REFERENCE_SCHEMA = SAMPLE_SCHEMA + ", reference_id string"
MODEL_SAMPLES = SAMPLE_SCHEMA + ", model_id string"


def _land(spark: SparkSession, samples: DataFrame) -> str:
    path = f"{shared_folder(spark)}/cohortforge/landing-{uuid.uuid4().hex}"
    samples.repartition(8, "sample_id").write.parquet(path)
    return path


def _as_maps(cells: DataFrame) -> DataFrame:
    """Cells as one expression map per sample (a group is one sample's genes)."""
    return cells.groupBy("sample_id").agg(
        F.min("expression_type").alias("expression_type"),
        F.map_from_entries(F.collect_list(F.struct("gene", "value"))).alias("expr"),
    )


def stream_reference_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = standins.dense_expression(spark, sf_dir).withColumn("expression_type", F.lit("dense"))
    train = cells.filter(F.col("gene").isin(MODEL_GENES))
    fitted = scaler.fit(train, ["cohort_id"])
    by_id = [("emb/dense20", MODEL_GENES), ("emb/dense5", MODEL_GENES[:5])]
    parts = [
        fitted.filter(F.col("gene").isin(genes)).select(F.lit(name).alias("reference_id"), F.lit("rowmean").alias("scoring"), "gene", "mean", "sd")
        for name, genes in by_id
    ]
    reference = written(parts[0].unionByName(parts[1]), "stream-reference")
    k = F.col("sample_id").cast("long") % 3
    asked = F.when(k == 0, "emb/dense20").when(k == 1, "emb/dense5").otherwise("emb/none").alias("reference_id")
    landing = _land(spark, _as_maps(cells).select("*", asked))
    out = sinks.run_available(spark, landing, REFERENCE_SCHEMA, lambda s: frozen.score_stream(s, reference))
    return _rounded(out, ["sample_id", "reference_id", "error_code"], ["score"])


def stream_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streamed predictions and rejects in one table; some samples ask for a model that isn't there."""
    model, constants, ranks = (written(part, "stream-model") for part in _model(spark, sf_dir))
    asked = F.when(F.col("sample_id").cast("long") % 11 == 7, "nobody").otherwise("dense20").alias("model_id")
    landing = _land(spark, _as_maps(_requests(spark, sf_dir).distinct()).select("*", asked))
    out = sinks.run_available(
        spark, landing, MODEL_SAMPLES, lambda s: frozen.predict_stream(s, model, constants, ranks)
    )
    good = _rounded(frozen.accepted(out), ["sample_id"], ["score", "relative_hazard", "training_percentile"])
    return good.withColumn("error_code", F.lit("")).unionByName(
        frozen.rejected(out).select("sample_id", "error_code"), allowMissingColumns=True
    )


def cohort_build_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole build over linear values: harmonise, log, filter, endpoint, analysis set."""
    raw = standins.linear_expression(spark, sf_dir).select(
        "cohort_id",
        F.col("gene").alias("feature"),
        F.split_part("gene", F.lit("#"), F.lit(2)).cast("long").alias("feature_pos"),
        "sample_id",
        "value",
    )
    out = cohort_build.build_cohorts(
        written(raw, "raw-matrix"),
        standins.clinical_raw(spark, sf_dir),
        specs(spark, sf_dir),
        standins.aliases(spark),
        rules=RULES,
    )
    return out["matrix"].groupBy("cohort_id").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.countDistinct("gene").alias("n_genes"),
        F.countDistinct("sample_id").alias("n_samples"),
        F.round(F.avg("value"), 6).alias("mean_value"),
        F.round(F.max("value"), 6).alias("max_value"),
    )


def verify_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplied tables as recorded outputs, one record altered and one absent."""
    # Read several times, so the files are digested once.
    found = written(provenance.file_inventory(spark, sf_dir, "*.parquet"), "inventory")
    name = F.col("name")
    recorded = found.select(
        F.when(name == "region.parquet", F.lit("/gone/absent.parquet")).otherwise(F.col("path")).alias("name"),
        F.when(name == "nation.parquet", F.lit("sha256:0")).otherwise(F.col("checksum")).alias("checksum"),
    )
    out = provenance.verify_outputs(recorded, found)
    return out.select(F.element_at(F.split("name", "/"), -1).alias("name"), "status")


_STREAM_REFERENCE = f"""
WITH {X2}, m AS (SELECT * FROM x2 WHERE pos < 20),
sc AS (SELECT gene, avg(value) AS mean, CASE WHEN stddev_samp(value) >= 1e-8 THEN stddev_samp(value) END AS sd
       FROM m GROUP BY 1)
SELECT sample_id, CASE CAST(sample_id AS BIGINT) % 3 WHEN 0 THEN 'emb/dense20' WHEN 1 THEN 'emb/dense5' ELSE 'emb/none' END AS reference_id,
       CASE CAST(sample_id AS BIGINT) % 3 WHEN 2 THEN 'unknown_reference' ELSE '' END AS error_code,
       CASE CAST(sample_id AS BIGINT) % 3 WHEN 0 THEN {r('avg(coalesce((value - mean) / sd, 0))')}
            WHEN 1 THEN {r('avg(coalesce((value - mean) / sd, 0)) FILTER (pos < 5)')} END AS score
FROM m JOIN sc USING (gene) GROUP BY sample_id"""

_STREAM_PREDICT = f"""WITH {sq._MODEL},
z AS (SELECT sample_id, sum((value - mean) / sd) / 20 AS raw FROM req JOIN sc USING (gene) WHERE k NOT IN (3, 4, 5, 7) GROUP BY 1),
s AS (SELECT sample_id, (raw - cm) / csd AS score FROM z, cs)
SELECT sample_id, {r('score')} AS score, {r('exp(score * 0.58e0)')} AS relative_hazard,
       {r('100e0 * (SELECT count(*) FROM ref WHERE ref.s <= score) / (SELECT count(*) FROM ref)')} AS training_percentile, '' AS error_code
FROM s
UNION ALL
SELECT CAST(vec_id AS VARCHAR), NULL, NULL, NULL,
       CASE vec_id % 11 WHEN 3 THEN 'MISSING_REQUIRED_GENES' WHEN 4 THEN 'NONFINITE_EXPRESSION' WHEN 7 THEN 'MODEL_NOT_FOUND' ELSE 'INCOMPATIBLE_EXPRESSION_TYPE' END
FROM embeddings WHERE vec_id % 11 IN (3, 4, 5, 7)"""

_BUILD = f"""
WITH {alias_values()}, {X1}, {X6},
targets AS (SELECT alias, count(DISTINCT approved) AS k, min(approved) AS approved FROM alias GROUP BY 1),
res AS (SELECT cohort_id, CAST(split_part(l.gene, '#', 2) AS BIGINT) AS pos, sample_id, value,
               CASE WHEN k = 1 AND approved <> l.gene THEN approved ELSE l.gene END AS gene
        FROM linear l LEFT JOIN targets ON upper(l.gene) = alias),
m AS (SELECT cohort_id, gene, pos, avg(value) AS mean FROM res GROUP BY 1, 2, 3),
w AS (SELECT cohort_id, gene, pos FROM m QUALIFY row_number() OVER (PARTITION BY cohort_id, gene ORDER BY mean DESC NULLS LAST, pos) = 1),
one AS (SELECT res.* FROM res JOIN w USING (cohort_id, gene, pos)),
kept AS (SELECT cohort_id, sample_id FROM aset WHERE status <> 'P' AND c_nationkey % 7 <> 0 AND c_nationkey <> 3
         AND c_nationkey BETWEEN 1 AND 24 AND position('2' IN CAST(c_nationkey AS VARCHAR)) = 0),
lg AS (SELECT cohort_id, gene, sample_id, log2(greatest(value, 0e0) + 1) AS value FROM one JOIN kept USING (cohort_id, sample_id))
SELECT cohort_id, count(*) AS n_cells, count(DISTINCT gene) AS n_genes, count(DISTINCT sample_id) AS n_samples,
       {r('avg(value)')} AS mean_value, {r('max(value)')} AS max_value FROM lg GROUP BY 1"""

QUERIES = {
    "stream_reference_score": (stream_reference_score, _STREAM_REFERENCE),
    "stream_predict": (stream_predict, _STREAM_PREDICT),
    "cohort_build_counts": (cohort_build_counts, _BUILD),
    "verify_outputs": (verify_outputs, None),
}
