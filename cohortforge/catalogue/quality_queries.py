"""Registered queries: scale inference, quality findings, expectations, hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortforge.catalogue.base_sql import LINEAR, X1, X2, X6, checksum_sql, r, signature_values
from cohortforge.catalogue.endpoint_queries import derived
from cohortforge.functions import hashing
from cohortforge.functions.numeric import round_at
from cohortforge.functions.staging import written
from cohortforge.operators import endpoints, quality
from cohortforge.plans import standins
from cohortforge.sources import signature_specs


def _scale_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X10: one cohort per branch of the scale decision."""
    lines = standins.table(spark, sf_dir, "lineitem")
    part = standins.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    counts = lines.join(part, "l_partkey").groupBy("p_brand", "l_suppkey").agg(F.sum("l_quantity").alias("value"))
    dense = standins.dense_expression(spark, sf_dir).select("value")
    linear = standins.linear_expression(spark, sf_dir).select("value")
    cell = lambda name, df: df.select(F.lit(name).alias("cohort_id"), "value")
    cases = (
        cell("counts", counts)
        .unionByName(cell("linear", linear))
        .unionByName(cell("log", linear.select(F.log2(1 + F.col("value")).alias("value"))))
        .unionByName(cell("z", dense))
        .unionByName(cell("array", dense.select((F.col("value") + 0.2).alias("value"))))
    )
    # Read several times by the verbs, so the joins behind it run once.
    return written(cases, "scale-cases")


def scale_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.infer_scale(_scale_cases(spark, sf_dir))
    return out.select(
        "cohort_id",
        "scale",
        "assay",
        *[round_at(F.col(c)).alias(c) for c in ("minimum", "maximum", "median", "frac_negative")],
        F.col("integer_valued").cast("int").alias("integer_valued"),
    )


def log_when_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _scale_cases(spark, sf_dir)
    out = quality.log_if_linear(cases, quality.infer_scale(cases))
    return out.groupBy("cohort_id").agg(
        F.count("value").alias("n"),
        round_at(F.avg("value")).alias("mean_value"),
        round_at(F.max("value")).alias("max_value"),
    )


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 over a sparse gene set, with a duplicated symbol, a flat gene and flat samples."""
    base = standins.expression(spark, sf_dir, stored=False)
    number = F.split_part("gene", F.lit("#"), F.lit(2)).cast("long")
    cells = base.select(
        "cohort_id",
        F.when(number == 25, F.lit("Brand#24")).otherwise(F.col("gene")).alias("gene"),
        number.alias("feature_pos"),
        "sample_id",
        F.when(number == 23, F.lit(1.0)).otherwise(F.col("value")).alias("value"),
    )
    return written(cells, "qc-matrix")


def qc_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = endpoints.analysis_set(derived(spark, sf_dir)).select("cohort_id", "sample_id", "event")
    out = quality.findings(_matrix(spark, sf_dir), events)
    return out.select(
        "cohort_id", "level", "code", round_at(F.col("n")).alias("n"), F.array_join("examples", ",").alias("examples")
    )


PLANTED_CODES = ["n_samples", "scale", "flat_samples", "endpoint_missing", "event_count", "event_rate"]


def qc_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohorts of customers, each with one defect: flat samples, a linear scale, no endpoint,
    events only, few events, few samples."""
    key, turn = F.col("c_custkey"), F.floor(F.col("c_custkey") / 8)
    k = key % 8
    cohort = F.when(k == 7, F.concat(F.lit("tiny"), (turn % 20).cast("string"))).otherwise(F.concat(F.lit("q"), k.cast("string")))
    event = F.when(k == 2, F.lit(None)).when(k == 3, 1).when(k == 4, (turn % 40 == 0).cast("int")).otherwise((turn % 2).cast("int"))
    people = standins.table(spark, sf_dir, "customer").select(
        cohort.alias("cohort_id"), key.cast("string").alias("sample_id"), event.cast("int").alias("event"), "c_custkey"
    )
    gene = F.explode(F.array(*[F.lit(g) for g in (1, 2, 3)]))
    value = ((key * (7 + 4 * F.col("g"))) % 97) / 10.0 + F.col("g") * F.col("g")
    cells = people.withColumn("g", gene).select(
        "cohort_id",
        F.format_string("g%d", F.col("g")).alias("gene"),
        F.col("g").cast("long").alias("feature_pos"),
        "sample_id",
        F.when(k == 0, 2.0 + key % 5).when(k == 1, value * 37.3).otherwise(value).alias("value"),
    )
    out = quality.findings(written(cells, "planted"), people)
    return out.where(F.col("code").isin(PLANTED_CODES)).select("cohort_id", "level", "code")


def qc_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = endpoints.analysis_set(derived(spark, sf_dir)).select("cohort_id", "sample_id", "event")
    out = quality.verdict(quality.findings(_matrix(spark, sf_dir), events))
    return out.withColumn("ok", F.col("ok").cast("int"))


def qc_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.coverage_findings(standins.expression(spark, sf_dir), standins.signatures(spark))
    return out.select(
        "cohort_id", "signature", "level", round_at(F.col("coverage")).alias("coverage"),
        F.array_join("missing", ",").alias("missing"), "n_samples_incomplete",
    )


def expectation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = standins.expression(spark, sf_dir)
    kept = endpoints.analysis_set(derived(spark, sf_dir))
    built = (
        kept.groupBy("cohort_id")
        .agg(F.count(F.lit(1)).alias("n_samples"), F.sum("event").alias("n_events"))
        .join(matrix.groupBy("cohort_id").agg(F.countDistinct("gene").alias("n_genes")), "cohort_id")
    )
    return quality.check_expectations(built, standins.expectations(spark))


def population_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hashing.population_hash(standins.expression(spark, sf_dir, stored=False), ["cohort_id"])
    return out.select("cohort_id", "n_samples", "population_hash")


def _signature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The literal signatures plus one weighted signature per size class read from part."""
    derived_rows = standins.table(spark, sf_dir, "part").groupBy("p_brand", (F.col("p_size") % 5).alias("k")).agg(
        F.round(F.avg("p_retailprice") / 1000, 4).alias("coefficient")
    )
    return standins.signatures(spark).select("signature", "gene", "coefficient").unionByName(
        derived_rows.select(
            F.format_string("part%d", F.col("k")).alias("signature"), F.col("p_brand").alias("gene"), "coefficient"
        )
    )


def signature_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashing.signature_checksum(_signature_table(spark, sf_dir))


def signature_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signature specs derived from part, one defect per size class, validated."""
    part = standins.table(spark, sf_dir, "part")
    specs = part.groupBy("p_size").agg(
        F.array_sort(F.collect_set("p_brand")).alias("genes"), F.max("p_retailprice").alias("w")
    )
    k = F.col("p_size") % 8
    weights = F.when(
        k.isin(2, 6, 7),
        F.map_from_entries(F.transform("genes", lambda g: F.struct(g.alias("key"), F.lit(0.5).alias("value")))),
    ).when(k == 3, F.map_from_arrays(F.slice("genes", 1, 1), F.array(F.lit(0.5))))
    specs = specs.select(
        F.format_string("size%d", F.col("p_size")).alias("name"),
        F.when(k == 0, F.slice("genes", 1, 0))
        .when(k == 1, F.concat("genes", F.slice("genes", 1, 1)))
        .otherwise(F.col("genes")).alias("genes"),
        weights.alias("coefficients"),
        F.when(k == 4, F.lit("mode")).when(k.isin(2, 5), F.lit("weighted")).otherwise("rowmean").alias("scoring"),
        F.when(k == 7, F.lit(None).cast("string")).when(k == 2, signature_specs.checksum_column("genes", weights))
        .otherwise(F.lit("sha256:0")).alias("checksum"),
    )
    out = signature_specs.validate(specs)
    return out.select("signature", F.col("ok").cast("int").alias("ok"), "error_code", "n_genes")


def content_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashing.content_checksum(
        standins.dense_expression(spark, sf_dir), ["cohort_id"], ["gene", "sample_id", "value"]
    )


_CASES = f"""
WITH {LINEAR}, {X2},
cells AS (
  SELECT 'counts' AS cohort_id, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, l_suppkey
  UNION ALL SELECT 'linear', value FROM linear UNION ALL SELECT 'log', log2(1 + value) FROM linear
  UNION ALL SELECT 'z', value FROM x2 UNION ALL SELECT 'array', value + 0.2e0 FROM x2),
s AS (SELECT cohort_id, min(value) AS minimum, max(value) AS maximum, quantile_cont(value, 0.5) AS median,
             avg(CAST(value < 0 AS DOUBLE)) AS fneg, bool_and(abs(value - round(value)) < 1e-9) AS iv
      FROM cells GROUP BY 1),
d AS (SELECT *, CASE WHEN maximum > 30 THEN 'linear' WHEN fneg > 0.4 AND abs(median) < 0.5 AND maximum < 10 THEN 'z' ELSE 'log' END AS scale,
             CASE WHEN maximum > 30 AND iv THEN 'rna-seq-counts' WHEN maximum > 30 THEN 'rna-seq-normalised'
                  WHEN fneg > 0.4 AND abs(median) < 0.5 AND maximum < 10 THEN 'unknown'
                  WHEN fneg > 0.01 THEN 'array' ELSE 'rna-seq-normalised' END AS assay FROM s)"""

_SCALE = f"""{_CASES}
SELECT cohort_id, scale, assay, {r('minimum')} AS minimum, {r('maximum')} AS maximum, {r('median')} AS median,
       {r('fneg')} AS frac_negative, CAST(iv AS INTEGER) AS integer_valued FROM d"""

_LOG = f"""{_CASES},
l AS (SELECT cells.cohort_id, CASE WHEN scale = 'linear' THEN log2(greatest(value, 0e0) + 1) ELSE value END AS value
      FROM cells JOIN d USING (cohort_id))
SELECT cohort_id, count(value) AS n, {r('avg(value)')} AS mean_value, {r('max(value)')} AS max_value FROM l GROUP BY 1"""

_FINDINGS = f"""
WITH {X1}, {X6},
m AS (SELECT cohort_id, CASE WHEN k = 25 THEN 'Brand#24' ELSE gene END AS gene, k AS pos, sample_id,
             CASE WHEN k = 23 THEN 1e0 ELSE value END AS value
      FROM (SELECT *, CAST(split_part(gene, '#', 2) AS BIGINT) AS k FROM x1)),
g AS (SELECT cohort_id, gene, count(value) AS nv, var_samp(value) AS v, count(DISTINCT pos) AS nr FROM m GROUP BY 1, 2),
s AS (SELECT cohort_id, sample_id, count(value) AS nv, stddev_samp(value) AS sd FROM m GROUP BY 1, 2),
sh AS (SELECT cohort_id, ng, nc, ns FROM
         (SELECT cohort_id, sum(nr) AS ng, sum(nv) AS nc FROM g GROUP BY 1)
         JOIN (SELECT cohort_id, count(*) AS ns FROM s GROUP BY 1) USING (cohort_id)),
sc AS (SELECT cohort_id, max(value) AS mx, min(value) AS mn FROM m GROUP BY 1),
ev AS (SELECT cohort_id, count(event) AS n, sum(event) AS e FROM aset GROUP BY 1),
bad AS (
  SELECT cohort_id, 'WARN' AS level, 'gene_missingness' AS code, gene AS item FROM g JOIN sh USING (cohort_id) WHERE 1 - nv * 1e0 / (ns * nr) > 0.2
  UNION ALL SELECT cohort_id, 'FAIL', 'sample_missingness', sample_id FROM s JOIN sh USING (cohort_id) WHERE 1 - nv * 1e0 / ng > 0.2
  UNION ALL SELECT cohort_id, 'WARN', 'zero_variance', gene FROM g WHERE coalesce(v, 0) = 0
  UNION ALL SELECT cohort_id, 'FAIL', 'flat_samples', sample_id FROM s WHERE coalesce(sd, 0) = 0),
nb AS (SELECT cohort_id, level, code, count(*) AS n FROM bad GROUP BY 1, 2, 3),
eb AS (SELECT cohort_id, code, string_agg(item, ',' ORDER BY item) AS examples FROM
         (SELECT *, row_number() OVER (PARTITION BY cohort_id, code ORDER BY item) AS rn FROM bad) WHERE rn <= 10 GROUP BY 1, 2),
allf AS (
  SELECT cohort_id, level, code, n * 1e0 AS n, examples FROM nb JOIN eb USING (cohort_id, code)
  UNION ALL SELECT cohort_id, 'FAIL', 'duplicate_genes', sum(nr - 1) * 1e0, '' FROM g WHERE nr > 1 GROUP BY 1
  UNION ALL SELECT cohort_id, 'FAIL', 'n_samples', ns * 1e0, '' FROM sh WHERE ns < 30
  UNION ALL SELECT cohort_id, 'INFO', 'frac_missing', 1 - nc * 1e0 / (ng * ns), '' FROM sh
  UNION ALL SELECT cohort_id, 'WARN', 'scale', mx, '' FROM sc WHERE mx > 30
  UNION ALL SELECT cohort_id, CASE WHEN e >= 10 THEN 'WARN' ELSE 'FAIL' END, 'event_count', e * 1e0, '' FROM ev WHERE e < 20
  UNION ALL SELECT cohort_id, 'FAIL', 'event_rate', e * 1e0 / n, '' FROM ev WHERE e * 1e0 / n >= 0.85)"""

_QC = f"{_FINDINGS}\nSELECT cohort_id, level, code, {r('n')} AS n, examples FROM allf"
_QC_VERDICT = f"""{_FINDINGS}
SELECT cohort_id, CAST(bool_and(level <> 'FAIL') AS INTEGER) AS ok, count(*) FILTER (level = 'FAIL') AS n_failures,
       count(*) FILTER (level = 'WARN') AS n_warnings FROM allf GROUP BY 1"""

_QC_COVERAGE = f"""
WITH {signature_values()}, {X1},
present AS (SELECT DISTINCT cohort_id, gene FROM x1),
pairs AS (SELECT c.cohort_id, sig.signature, sig.gene, present.gene IS NOT NULL AS found
          FROM (SELECT DISTINCT cohort_id FROM present) c CROSS JOIN sig
          LEFT JOIN present ON present.cohort_id = c.cohort_id AND present.gene = sig.gene),
cov AS (SELECT cohort_id, signature, count(*) FILTER (found) AS nf, count(*) AS nt,
               coalesce(string_agg(gene, ',' ORDER BY gene) FILTER (NOT found), '') AS missing FROM pairs GROUP BY 1, 2),
k AS (SELECT cohort_id, signature, sample_id, count(DISTINCT x1.gene) AS k FROM x1 JOIN sig USING (gene) GROUP BY 1, 2, 3),
full_ AS (SELECT cohort_id, signature, count(*) AS nc FROM k JOIN cov USING (cohort_id, signature) WHERE k = nf GROUP BY 1, 2),
ns AS (SELECT cohort_id, count(DISTINCT sample_id) AS n FROM x1 GROUP BY 1)
SELECT cohort_id, signature, CASE WHEN nf * 1e0 / nt >= 0.9 THEN 'INFO' ELSE 'WARN' END AS level,
       {r('nf * 1e0 / nt')} AS coverage, missing, CASE WHEN nf > 0 THEN n - coalesce(nc, 0) END AS n_samples_incomplete
FROM cov JOIN ns USING (cohort_id) LEFT JOIN full_ USING (cohort_id, signature)"""

_EXPECT_ROWS = ", ".join(f"('{a}', {b}, {c}, {d}, {e})" for a, b, c, d, e in standins.EXPECTATION_ROWS)
_EXPECT = f"""
WITH {X1}, {X6}, ex(cohort_id, want_n, tol, min_g, min_e) AS (SELECT * FROM (VALUES {_EXPECT_ROWS})),
b AS (SELECT cohort_id, count(*) AS n, sum(event) AS e FROM aset GROUP BY 1),
g AS (SELECT cohort_id, count(DISTINCT gene) AS ng FROM x1 GROUP BY 1),
j AS (SELECT * FROM b JOIN g USING (cohort_id) JOIN ex USING (cohort_id))
SELECT cohort_id, 'n_samples' AS problem, CAST(want_n AS BIGINT) AS expected, n AS observed FROM j WHERE abs(n - want_n) > tol
UNION ALL SELECT cohort_id, 'n_genes', CAST(min_g AS BIGINT), ng FROM j WHERE ng < min_g
UNION ALL SELECT cohort_id, 'n_events', CAST(min_e AS BIGINT), CAST(e AS BIGINT) FROM j WHERE e < min_e"""

_POPULATION = f"""
WITH {X1}, s AS (SELECT DISTINCT cohort_id, sample_id FROM x1)
SELECT cohort_id, count(*) AS n_samples, 'sha256:' || sha256(string_agg(sample_id, chr(10) ORDER BY sample_id)) AS population_hash
FROM s GROUP BY 1"""

_SIG_CHECKSUM = f"""
WITH {signature_values()},
t AS (SELECT signature, gene, coefficient FROM sig
      UNION ALL SELECT 'part' || (p_size % 5), p_brand, round(avg(p_retailprice) / 1000, 4) FROM part GROUP BY p_brand, p_size % 5),
l AS (SELECT signature, string_agg(gene, chr(10) ORDER BY gene) AS g,
             string_agg(gene || '=' || printf('%.9f', coefficient), chr(10) ORDER BY gene) FILTER (coefficient IS NOT NULL) AS c
      FROM t GROUP BY 1)
SELECT signature, 'sha256:' || sha256(g || coalesce(chr(10) || c, '')) AS checksum FROM l"""

_SIG_VALIDATE = """
WITH p AS (SELECT p_size, count(DISTINCT p_brand) AS n FROM part GROUP BY 1),
e AS (SELECT p_size, CASE p_size % 8 WHEN 0 THEN 0 WHEN 1 THEN n + 1 ELSE n END AS n_genes,
             CASE p_size % 8 WHEN 0 THEN 'empty_gene_list' WHEN 1 THEN 'duplicate_genes'
                  WHEN 3 THEN CASE WHEN n = 1 THEN 'checksum_mismatch' ELSE 'coefficients_not_exact' END
                  WHEN 4 THEN 'unknown_scoring' WHEN 5 THEN 'weighted_without_coefficients' WHEN 6 THEN 'checksum_mismatch'
                  WHEN 7 THEN 'missing_checksum' END AS error_code
      FROM p)
SELECT 'size' || p_size AS signature, CAST(error_code IS NULL AS INTEGER) AS ok, coalesce(error_code, '') AS error_code,
       CAST(n_genes AS BIGINT) AS n_genes FROM e"""

QUERIES = {
    "scale_inference": (scale_inference, _SCALE),
    "log_when_linear": (log_when_linear, _LOG),
    "qc_findings": (qc_findings, _QC),
    "qc_planted": (
        qc_planted,
        """WITH s AS (SELECT c_custkey % 8 AS k, c_custkey // 8 AS turn FROM customer),
n AS (SELECT CASE WHEN k = 7 THEN 'tiny' || (turn % 20) ELSE 'q' || k END AS cohort_id, any_value(k) AS k, count(*) AS n,
  count(*) FILTER (k <> 2) AS scored,
  count(*) FILTER (CASE k WHEN 2 THEN false WHEN 3 THEN true WHEN 4 THEN turn % 40 = 0 ELSE turn % 2 = 1 END) AS ev FROM s GROUP BY 1)
SELECT cohort_id, 'FAIL' AS level, 'n_samples' AS code FROM n WHERE n < 30
UNION ALL SELECT cohort_id, 'WARN', 'scale' FROM n WHERE k = 1
UNION ALL SELECT cohort_id, 'FAIL', 'flat_samples' FROM n WHERE k = 0
UNION ALL SELECT cohort_id, 'FAIL', 'endpoint_missing' FROM n WHERE scored = 0
UNION ALL SELECT cohort_id, CASE WHEN ev >= 10 THEN 'WARN' ELSE 'FAIL' END, 'event_count' FROM n WHERE ev < 20 AND scored > 0
UNION ALL SELECT cohort_id, 'FAIL', 'event_rate' FROM n WHERE scored > 0 AND ev * 1e0 / scored >= 0.85""",
    ),
    "qc_verdict": (qc_verdict, _QC_VERDICT),
    "qc_coverage": (qc_coverage, _QC_COVERAGE),
    "expectation_check": (expectation_check, _EXPECT),
    "population_hash": (population_hash, _POPULATION),
    "signature_checksum": (signature_checksum, _SIG_CHECKSUM),
    "signature_validate": (signature_validate, _SIG_VALIDATE),
    "content_checksum": (
        content_checksum,
        f"""WITH {X2} SELECT cohort_id, count(*) AS n_rows,
  {checksum_sql([("gene", "text"), ("sample_id", "text"), ("value", "double")])} AS content_checksum FROM x2 GROUP BY cohort_id""",
    ),
}
