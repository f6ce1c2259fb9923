"""Registered queries: harmonisation, aliquots and patient assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortforge.catalogue.base_sql import X1, X4, X8, alias_values, r, signature_values
from cohortforge.functions.numeric import round_at
from cohortforge.operators import harmonise
from cohortforge.plans import assembly, standins


def _collapse(rule: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        probes = harmonise.probe_map(standins.probe_annotation(spark, sf_dir))
        out = harmonise.map_probes(standins.probe_expression(spark, sf_dir), probes, rule)
        return out.select(
            "cohort_id", "gene", "sample_id", round_at(F.col("value")).alias("value"), "n_rows_collapsed"
        )

    return query


def probe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = harmonise.probe_map(standins.probe_annotation(spark, sf_dir))
    out = harmonise.probe_report(standins.probe_expression(spark, sf_dir), probes)
    return out.withColumn("no_match", F.col("no_match").cast("int"))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 with the row label still unresolved; the brand number is the row position."""
    return standins.expression(spark, sf_dir).select(
        "cohort_id",
        F.col("gene").alias("feature"),
        F.split_part("gene", F.lit("#"), F.lit(2)).cast("long").alias("feature_pos"),
        "sample_id",
        "value",
    )


def alias_harmonise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonise.symbol_report(_features(spark, sf_dir), standins.aliases(spark))


def alias_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = harmonise.harmonise(_features(spark, sf_dir), standins.aliases(spark))
    return out.select(
        "cohort_id", "gene", "sample_id", round_at(F.col("value")).alias("value"), "n_rows_collapsed"
    )


def signature_outdated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renamed signature genes, with the number of matrix cells each one misses."""
    listed = standins.signatures(spark).unionByName(
        standins.signatures(spark)
        .filter(F.col("signature") == "tiny")
        .withColumn("signature", F.lit("old"))
        .withColumn("gene", F.replace("gene", F.lit("Brand#1"), F.lit("Brand#21")))
    )
    outdated = harmonise.outdated_signature_genes(listed, standins.aliases(spark))
    cells = standins.expression(spark, sf_dir).groupBy(F.col("gene").alias("listed")).agg(
        F.count(F.lit(1)).alias("n_cells")
    )
    return outdated.join(cells, "listed").select("signature", "listed", "approved", "n_cells")


def primary_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = harmonise.parse_barcodes(standins.aliquots(spark, sf_dir))
    return harmonise.primary_samples(parsed).select(
        "patient", "barcode", round_at(F.col("value")).alias("value")
    )


def patient_level_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = harmonise.parse_barcodes(standins.aliquots(spark, sf_dir))
    out = harmonise.to_patients(harmonise.primary_samples(parsed), "first")
    return out.select("patient", "barcode", round_at(F.col("value")).alias("value"))


def patient_level_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = harmonise.parse_barcodes(standins.aliquots(spark, sf_dir))
    out = harmonise.to_patients(harmonise.primary_samples(parsed), "mean")
    return out.select("patient", "n_aliquots", round_at(F.col("value")).alias("value"))


def assemble_patient_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts at every loss stage of patient-level assembly."""
    aliquots = standins.aliquots(spark, sf_dir)
    lines = standins.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    parts = standins.table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    cells = (
        lines.join(parts, lines["l_partkey"] == parts["p_partkey"])
        .join(aliquots.select("barcode", "o_orderkey"), lines["l_orderkey"] == F.col("o_orderkey"))
        .groupBy("barcode", F.col("p_brand").alias("gene"))
        .agg(F.sum("l_extendedprice").alias("value"))
    )
    clinical = (
        harmonise.parse_barcodes(aliquots)
        .groupBy("patient")
        .agg(F.max("value").alias("_top"))
        .filter(F.col("_top") > 200000)
        .select("patient")
    )
    manifest = aliquots.select("barcode")
    return assembly.loss_counts(manifest, cells, clinical)


_COLLAPSE_SQL = {
    "max_mean": f"""
WITH {X4},
m AS (SELECT cohort_id, gene, feature_pos, avg(value) AS mean FROM mapped GROUP BY 1, 2, 3),
n AS (SELECT cohort_id, gene, count(*) AS n_rows_collapsed FROM m GROUP BY 1, 2),
w AS (SELECT cohort_id, gene, feature_pos FROM m
      QUALIFY row_number() OVER (PARTITION BY cohort_id, gene ORDER BY mean DESC NULLS LAST, feature_pos) = 1)
SELECT cohort_id, gene, sample_id, {r('value')} AS value, n_rows_collapsed
FROM mapped JOIN w USING (cohort_id, gene, feature_pos) JOIN n USING (cohort_id, gene)""",
    "first": f"""
WITH {X4},
w AS (SELECT cohort_id, gene, min(feature_pos) AS feature_pos, count(DISTINCT feature_pos) AS n_rows_collapsed
      FROM mapped GROUP BY 1, 2)
SELECT cohort_id, gene, sample_id, {r('value')} AS value, n_rows_collapsed
FROM mapped JOIN w USING (cohort_id, gene, feature_pos)""",
    "mean": f"""
WITH {X4},
w AS (SELECT cohort_id, gene, count(DISTINCT feature_pos) AS n_rows_collapsed FROM mapped GROUP BY 1, 2)
SELECT cohort_id, gene, sample_id, {r('avg(value)')} AS value, any_value(n_rows_collapsed) AS n_rows_collapsed
FROM mapped JOIN w USING (cohort_id, gene) GROUP BY 1, 2, 3""",
}

_PROBE_COUNTS = f"""
WITH {X4},
f AS (SELECT DISTINCT cohort_id, feature_pos FROM x4),
c AS (SELECT cohort_id, p_brand,
             CASE WHEN p_size % 17 = 0 THEN 'unmapped' WHEN p_size % 10 = 0 THEN 'multi' ELSE 'mapped' END AS status
      FROM f JOIN part ON feature_pos = p_partkey)
SELECT cohort_id, count(*) AS n_rows_in, count(*) FILTER (status = 'mapped') AS n_mapped,
       count(DISTINCT p_brand) FILTER (status = 'mapped') AS n_rows_out,
       count(*) FILTER (status = 'multi') AS n_dropped_multi,
       count(*) FILTER (status = 'unmapped') AS n_dropped_unmapped,
       CAST(count(*) FILTER (status = 'mapped') = 0 AS INTEGER) AS no_match
FROM c GROUP BY 1"""

_RESOLVE = f"""
WITH {alias_values()}, {X1},
targets AS (SELECT alias, count(DISTINCT approved) AS k, min(approved) AS approved FROM alias GROUP BY 1),
res AS (SELECT cohort_id, x1.gene AS feature, CAST(split_part(x1.gene, '#', 2) AS BIGINT) AS feature_pos,
               sample_id, value,
               CASE WHEN k = 1 AND approved <> x1.gene THEN approved ELSE x1.gene END AS gene,
               CASE WHEN k = 1 AND approved <> x1.gene THEN 'remapped' WHEN k > 1 THEN 'ambiguous' ELSE 'kept' END AS how
        FROM x1 LEFT JOIN targets ON upper(trim(x1.gene)) = targets.alias)"""

_ALIAS = f"""{_RESOLVE},
g AS (SELECT cohort_id, gene, count(*) AS k, count(*) FILTER (how = 'remapped') AS rm,
             count(*) FILTER (how = 'ambiguous') AS am
      FROM (SELECT DISTINCT cohort_id, feature, gene, how FROM res) GROUP BY 1, 2)
SELECT cohort_id, CAST(sum(k) AS BIGINT) AS n_input, count(*) AS n_output, CAST(sum(rm) AS BIGINT) AS n_remapped,
       CAST(sum(am) AS BIGINT) AS n_ambiguous, count(*) FILTER (k > 1) AS n_collapsed
FROM g GROUP BY 1"""

_ALIAS_MATRIX = f"""{_RESOLVE},
m AS (SELECT cohort_id, gene, feature_pos, avg(value) AS mean FROM res GROUP BY 1, 2, 3),
n AS (SELECT cohort_id, gene, count(*) AS n_rows_collapsed FROM m GROUP BY 1, 2),
w AS (SELECT cohort_id, gene, feature_pos FROM m
      QUALIFY row_number() OVER (PARTITION BY cohort_id, gene ORDER BY mean DESC NULLS LAST, feature_pos) = 1)
SELECT cohort_id, gene, sample_id, {r('value')} AS value, n_rows_collapsed
FROM res JOIN w USING (cohort_id, gene, feature_pos) JOIN n USING (cohort_id, gene)"""

_OUTDATED = f"""
WITH {alias_values()}, {signature_values()}, {X1},
listed AS (SELECT signature, gene FROM sig
           UNION ALL SELECT 'old', replace(gene, 'Brand#1', 'Brand#21') FROM sig WHERE signature = 'tiny'),
targets AS (SELECT alias, count(DISTINCT approved) AS k, min(approved) AS approved FROM alias GROUP BY 1),
cells AS (SELECT gene, count(*) AS n_cells FROM x1 GROUP BY 1)
SELECT signature, listed.gene AS listed, approved, n_cells
FROM listed JOIN targets ON upper(listed.gene) = alias JOIN cells ON cells.gene = listed.gene
WHERE k = 1 AND approved <> listed.gene"""

_PRIMARY = f"WITH {X8} SELECT patient, barcode, {r('value')} AS value FROM aliq WHERE kind = '01'"

_FIRST = f"""WITH {X8}
SELECT patient, min(barcode) AS barcode, {r('arg_min(value, barcode)')} AS value
FROM aliq WHERE kind = '01' GROUP BY 1"""

_MEAN = f"""WITH {X8}
SELECT patient, count(DISTINCT barcode) AS n_aliquots, {r('avg(value)')} AS value
FROM aliq WHERE kind = '01' GROUP BY 1"""

_ASSEMBLE = f"""
WITH {X8},
cells AS (SELECT barcode, patient, kind, p_brand AS gene FROM lineitem JOIN part ON l_partkey = p_partkey
          JOIN aliq ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4),
landed AS (SELECT DISTINCT barcode, patient, kind FROM cells),
prim AS (SELECT * FROM landed WHERE kind = '01'),
pat AS (SELECT DISTINCT patient FROM prim),
clin AS (SELECT patient FROM aliq GROUP BY 1 HAVING max(value) > 200000)
SELECT 'landed_files' AS stage, (SELECT count(*) FROM aliq) AS n_in, (SELECT count(*) FROM landed) AS n_out
UNION ALL SELECT 'primary_samples', (SELECT count(*) FROM landed), (SELECT count(*) FROM prim)
UNION ALL SELECT 'patients', (SELECT count(*) FROM prim), (SELECT count(*) FROM pat)
UNION ALL SELECT 'clinical_join', (SELECT count(*) FROM pat), (SELECT count(*) FROM pat JOIN clin USING (patient))"""

QUERIES = {
    **{f"probe_collapse_{rule}": (_collapse(rule), _COLLAPSE_SQL[rule]) for rule in harmonise.COLLAPSE_RULES},
    "probe_counts": (probe_counts, _PROBE_COUNTS),
    "alias_harmonise": (alias_harmonise, _ALIAS),
    "alias_matrix": (alias_matrix, _ALIAS_MATRIX),
    "signature_outdated": (signature_outdated, _OUTDATED),
    "primary_samples": (primary_samples, _PRIMARY),
    "patient_level_first": (patient_level_first, _FIRST),
    "patient_level_mean": (patient_level_mean, _MEAN),
    "assemble_patient_matrix": (assemble_patient_matrix, _ASSEMBLE),
}
