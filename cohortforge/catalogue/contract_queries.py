"""Registered queries: contracts between tables, transfer of frozen models, exports and records of a run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortforge.catalogue import survival_queries as sq
from cohortforge.catalogue.base_sql import LINEAR, X6, r
from cohortforge.functions.hashing import population_hash, tagged_sha
from cohortforge.functions.staging import shared_folder, written
from cohortforge.operators import adjudication, crossval, endpoints, provenance, quality, scaler
from cohortforge.plans import development, standins
from cohortforge.sources import store


def feature_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every way a matrix and its outcomes can break the contract, planted by sample number."""
    population, matrix, _ = sq._cv_inputs(spark, sf_dir)
    k = F.col("sample_id").cast("long") % 13
    broken = F.when((k == 4) & (F.col("gene") == "Brand#7"), float("nan")).when((k == 5) & (F.col("gene") == "Brand#9"), F.lit(None))
    cells = matrix.filter(k != 2).withColumn("value", broken.otherwise(F.col("value")))
    cells = cells.filter(~((k == 6) & (F.col("gene") == "Brand#1"))).unionByName(matrix.filter((k == 7) & (F.col("gene") == "Brand#2")))
    outcomes = population.filter(k != 1).unionByName(population.filter(k == 3))
    return crossval.contract_problems(cells, outcomes, sq.CV_GENES)


def sample_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with finished orders against those with open ones, some listed twice."""
    orders = standins.table(spark, sf_dir, "orders")
    people = standins.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("cohort_id"))

    def side(status: str, twice: int) -> DataFrame:
        ids = orders.filter(F.col("o_orderstatus") == status).select("o_custkey").distinct().join(people, "o_custkey")
        ids = ids.unionByName(ids.filter(F.col("o_custkey") % 17 == twice))
        return ids.select("cohort_id", F.col("o_custkey").cast("string").alias("sample_id"))

    return endpoints.misaligned(side("F", 1), side("O", 2)).select("cohort_id", "problem", "n")


def log2_pseudocount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logarithms of shifted revenue, with the values they can't represent."""
    raw = written(
        standins.linear_expression(spark, sf_dir).select("cohort_id", "gene", "sample_id", (F.col("value") - 60000).alias("value")), "shifted"
    )
    lost = quality.log2_losses(raw, 0.5)
    means = quality.log2_transform(raw, 0.5).groupBy("cohort_id").agg(F.count("value").alias("n_values"), F.avg("value").alias("mean_value"))
    return sq._rounded(lost.join(means, "cohort_id"), ["cohort_id", "n_lost", "n_values"], ["mean_value"])


def reference_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict scoring by every segment's reference where one segment lacks a gene and one reference is of another method."""
    reference = written(sq._references(spark, sf_dir), "references")
    other = reference.filter("reference_id = 'FURNITURE/s20'").withColumn("scoring", F.lit("median_z"))
    reference = written(reference.filter("reference_id != 'FURNITURE/s20'").unionByName(other), "references-mixed")
    test = sq._halves(spark, sf_dir).filter("NOT train").filter("NOT (cohort_id = 'BUILDING' AND gene = 'Brand#5')")
    test = written(test, "strict-test")
    refused = scaler.reference_refusals(test, reference)
    scored = scaler.score_reference(test, reference).groupBy("cohort_id", "reference_id").agg(
        F.count("score").alias("n_scored"), F.avg("score").alias("mean_score")
    )
    both = refused.select("cohort_id", "reference_id", "error_code").join(scored, ["cohort_id", "reference_id"], "full_outer")
    return sq._rounded(both, ["cohort_id", "reference_id", "error_code", "n_scored"], ["mean_score"])


def transfer_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear model frozen on one half of each segment, applied to the other half."""
    halves = written(sq._halves(spark, sf_dir), "halves")
    fitted = scaler.fit(halves.filter("train"), ["cohort_id"])
    number = F.split_part("gene", F.lit("#"), F.lit(2)).cast("int")
    weights = fitted.select("cohort_id", F.col("gene").alias("feature"), ((number - 10) / 50).alias("coefficient"))
    out = crossval.apply_model(halves.filter("NOT train"), fitted, weights, ["cohort_id"])
    return sq._rounded(out, ["cohort_id", "sample_id"], ["risk"])


def exported_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validation tables exported and read back."""
    population, matrix, plan = sq._cv_inputs(spark, sf_dir)
    tables = crossval.fixed_signature_cv(matrix, population, plan)
    path = f"{shared_folder(spark)}/cohortforge/export-{uuid.uuid4().hex}"
    store.export_tables(tables, path)
    held = spark.read.parquet(f"{path}/predictions").groupBy("repeat", "fold").agg(
        F.count(F.lit(1)).alias("n_predictions"), F.sum("event").alias("n_events")
    )
    sizes = spark.read.parquet(f"{path}/folds").select("repeat", "fold", "n_train", "n_test", "error")
    return sizes.join(held, ["repeat", "fold"])


def gathered_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of different runs and columns as one."""
    people = standins.table(spark, sf_dir, "customer")
    tables = {}
    for segment in ("AUTOMOBILE", "BUILDING"):
        own = people.filter(F.col("c_mktsegment") == segment)
        tables[segment, "size"] = own.agg(F.count(F.lit(1)).alias("n"))
        tables[segment, "nations"] = own.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return development.gather_results(tables)


def snapshot_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity of a snapshot whose files are the orders of a day."""
    orders = standins.table(spark, sf_dir, "orders")
    records = orders.groupBy(F.col("o_orderdate").cast("string").alias("source")).agg(
        tagged_sha(F.concat_ws("|", F.count(F.lit(1)).cast("string"), F.max("o_orderkey").cast("string"))).alias("checksum")
    )
    return adjudication.snapshot_checksum(records)


def recorded_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs of a run by hash."""
    people = standins.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("cohort_id"), F.col("c_custkey").cast("string").alias("sample_id"))
    cohorts = population_hash(people, ["cohort_id"]).select("cohort_id", F.col("population_hash").alias("content_checksum"))
    signatures = standins.signatures(spark).select("signature").distinct().withColumn("checksum", tagged_sha(F.col("signature")))
    authority = standins.aliases(spark).select(F.col("alias").alias("name"), tagged_sha(F.array_join("approved", ",")).alias("checksum"))
    return provenance.record_inputs("run-1", cohorts, signatures, authority).drop("at")


_CONTRACT = f"""WITH {X6}, {sq._POP}
SELECT 'all' AS cohort_id, problem, count(*) AS n FROM (
  SELECT CASE CAST(sample_id AS BIGINT) % 13 WHEN 1 THEN 'sample_without_outcome' WHEN 2 THEN 'outcome_without_sample' WHEN 3 THEN 'duplicate_labels'
              WHEN 4 THEN 'missing_or_nonfinite_value' WHEN 5 THEN 'missing_or_nonfinite_value' WHEN 6 THEN 'missing_or_nonfinite_value'
              WHEN 7 THEN 'duplicate_labels' END AS problem FROM pop) WHERE problem IS NOT NULL GROUP BY 2"""

_ALIGNMENT = """WITH s AS (SELECT DISTINCT c_mktsegment AS cohort_id, o_custkey, o_orderstatus AS st FROM orders JOIN customer ON o_custkey = c_custkey),
b AS (SELECT cohort_id, o_custkey, bool_or(st = 'F') AS f, bool_or(st = 'O') AS o FROM s WHERE st IN ('F', 'O') GROUP BY 1, 2),
p AS (SELECT cohort_id, CASE WHEN NOT o THEN 'expression_only' WHEN NOT f THEN 'clinical_only' WHEN o_custkey % 17 = 1 THEN 'duplicate_expression'
             WHEN o_custkey % 17 = 2 THEN 'duplicate_clinical' END AS problem FROM b)
SELECT cohort_id, problem, count(*) AS n FROM p WHERE problem IS NOT NULL GROUP BY 1, 2"""

_LOG2 = f"""WITH {LINEAR}, v AS (SELECT cohort_id, value - 60000 + 0.5e0 AS x FROM linear)
SELECT cohort_id, count(*) FILTER (x <= 0) AS n_lost, count(*) FILTER (x > 0) AS n_values,
       {r('avg(CASE WHEN x > 0 THEN log2(x) END)')} AS mean_value FROM v GROUP BY 1"""

_STRICT = f"""WITH {sq._HALF},
test AS (SELECT * FROM h WHERE NOT train AND NOT (cohort_id = 'BUILDING' AND gene = 'Brand#5')),
fits AS (SELECT scaler_id, count(*) AS n_genes FROM sc GROUP BY 1),
pr AS (SELECT g.cohort_id, scaler_id, count(*) AS n_present FROM (SELECT DISTINCT cohort_id, gene FROM test) g JOIN sc USING (gene) GROUP BY 1, 2),
code AS (SELECT cohort_id, scaler_id, n_present, CASE WHEN scaler_id = 'FURNITURE' THEN 'unsupported_method' WHEN n_present < n_genes THEN 'missing_reference_genes' END AS error_code
         FROM pr JOIN fits USING (scaler_id)),
z AS (SELECT test.cohort_id, scaler_id, sample_id, sum(coalesce((value - mean) / sd, 0)) AS z FROM test JOIN sc USING (gene) GROUP BY 1, 2, 3),
s AS (SELECT cohort_id, scaler_id, count(*) AS n_scored, avg(z / n_present) AS m FROM z JOIN code USING (cohort_id, scaler_id) WHERE error_code IS NULL GROUP BY 1, 2)
SELECT cohort_id, scaler_id || '/s20' AS reference_id, error_code, n_scored, {r('m')} AS mean_score FROM code LEFT JOIN s USING (cohort_id, scaler_id)"""

_TRANSFER = f"""WITH {sq._HALF}
SELECT h.cohort_id, sample_id, {r("sum(coalesce((value - mean) / sd, 0) * ((split_part(h.gene, '#', 2)::INTEGER - 10) / 50e0))")} AS risk
FROM h JOIN sc ON h.cohort_id = scaler_id AND h.gene = sc.gene WHERE NOT train GROUP BY 1, 2"""

_EXPORTED = f"""WITH {X6}, {sq._POP}, {sq.S.tested(sq.OUTER, sq.REPEATS)}
SELECT repeat, fold, sum(count(*)) OVER (PARTITION BY repeat)::BIGINT - count(*) AS n_train, count(*) AS n_test, CAST(NULL AS VARCHAR) AS error,
       count(*) AS n_predictions, CAST(sum(event) AS BIGINT) AS n_events FROM tested GROUP BY 1, 2"""

_GATHERED = """WITH c AS (SELECT * FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING'))
SELECT c_nationkey, count(*) AS n, c_mktsegment AS cohort, 'nations' AS action FROM c GROUP BY 1, 3
UNION ALL SELECT NULL, count(*), c_mktsegment, 'size' FROM c GROUP BY 3"""

_SNAPSHOT = """WITH d AS (SELECT DISTINCT 'sha256:' || sha256(concat_ws('|', count(*), max(o_orderkey))) AS checksum FROM orders GROUP BY CAST(o_orderdate AS VARCHAR))
SELECT 'sha256:' || sha256(string_agg(checksum, chr(10) ORDER BY checksum)) AS snapshot_checksum FROM d"""

_SIGNATURES = ", ".join(f"('{name}')" for name in sorted({row[0] for row in standins.SIGNATURE_ROWS}))
_ALIASES = ", ".join(f"('{a}', '{b}')" for a, b in standins.ALIAS_ROWS)
_RECORDED = f"""SELECT 'run-1' AS run_id, 'input' AS role, 'cohort' AS kind, c_mktsegment AS name,
  'sha256:' || sha256(string_agg(CAST(c_custkey AS VARCHAR), chr(10) ORDER BY CAST(c_custkey AS VARCHAR))) AS checksum FROM customer GROUP BY c_mktsegment
UNION ALL SELECT 'run-1', 'input', 'signature', s, 'sha256:' || sha256(s) FROM (VALUES {_SIGNATURES}) t(s)
UNION ALL SELECT 'run-1', 'input', 'symbol_authority', a, 'sha256:' || sha256(string_agg(b, ',' ORDER BY b)) FROM (VALUES {_ALIASES}) t(a, b) GROUP BY a"""

QUERIES = {
    "feature_contract": (feature_contract, _CONTRACT),
    "sample_alignment": (sample_alignment, _ALIGNMENT),
    "log2_pseudocount": (log2_pseudocount, _LOG2),
    "reference_strict": (reference_strict, _STRICT),
    "transfer_risk": (transfer_risk, _TRANSFER),
    "exported_folds": (exported_folds, _EXPORTED),
    "gathered_results": (gathered_results, _GATHERED),
    "snapshot_identity": (snapshot_identity, _SNAPSHOT),
    "recorded_inputs": (recorded_inputs, _RECORDED),
}
