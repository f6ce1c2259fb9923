"""Registered queries: commit logs, byte-range digests, clinical JSON with its problems, the assembled patient matrix."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortforge.catalogue.base_sql import checksum_sql, r
from cohortforge.functions.numeric import round_at
from cohortforge.functions.staging import dealt, shared_folder, written
from cohortforge.operators import harmonise, provenance
from cohortforge.plans import assembly, standins
from cohortforge.sources import byte_ranges, commits, repository_json

#: Cases of a clinical page, on average.
PAGE_ROWS = 10_000
RANGE_BYTES = 4096


def _path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/cohortforge/landing-{label}-{uuid.uuid4().hex}"


def store_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders appended by status: two appends committed, one torn before its commit, one file strayed into a batch."""
    orders = standins.table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_custkey", "o_totalprice")
    status = standins.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    orders = orders.join(status, "o_orderkey")
    by = ["o_orderpriority"]
    path = _path(spark, "commits")
    first = commits.append(orders.where("o_orderstatus = 'F'"), path, by)
    commits.append(orders.where("o_orderstatus = 'O'"), path, by)
    commits.stage(orders.where("o_orderstatus = 'P'"), path, by)
    stray = orders.where("o_orderstatus = 'P'")
    stray.write.mode("append").parquet(f"{path}/data/batch={first}")
    seen = commits.committed(spark, path).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_seen"), F.count_if(F.col("o_orderstatus") == "P").alias("n_torn")
    )
    n_bad = commits.verify(spark, path, by, every_file=True).where("status != 'ok'").count()
    return seen.join(commits.checksums(spark, path, by), by).withColumn("n_bad_files", F.lit(n_bad).cast("long"))


def range_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys as 64 text files, digested by ranges of 4 KB."""
    path = _path(spark, "ranges")
    keys = standins.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 64).alias("bucket"), "o_orderkey")
    keys = keys.repartition("bucket").sortWithinPartitions("bucket", "o_orderkey")
    keys.select("bucket", F.col("o_orderkey").cast("string")).write.partitionBy("bucket").text(path)
    files = byte_ranges.range_inventory(spark, path, "*.txt", RANGE_BYTES)
    return files.select(
        F.regexp_extract("path", r"bucket=(\d+)", 1).cast("long").alias("bucket"), "n_bytes", F.col("n_ranges").cast("long").alias("n_ranges"), "checksum"
    )


def range_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded range digests against files of which one bucket is gone, one has changed and one has moved."""
    path = _path(spark, "range-outputs")
    keys = standins.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 8).alias("bucket"), "o_orderkey")

    def land(rows: DataFrame, place: str) -> None:
        rows = rows.repartition("bucket").sortWithinPartitions("bucket", "o_orderkey")
        named = rows.select("bucket", F.col("o_orderkey").cast("string"))
        named.write.partitionBy("bucket").text(f"{path}/{place}")

    land(keys, "then")
    land(keys.where("bucket != 1 AND NOT (bucket = 2 AND o_orderkey % 3 = 0)"), "now")
    bucket = F.regexp_extract("path", r"bucket=(\d+)", 1)
    digests = lambda place: written(
        byte_ranges.range_inventory(spark, f"{path}/{place}", "*.txt", RANGE_BYTES).select(
            bucket.alias("path"), F.concat(F.lit("bucket"), bucket).alias("name"), "checksum"
        ),
        "range-inventory",
    )
    now = digests("now").withColumn("path", F.when(F.col("path") == "3", "elsewhere").otherwise(F.concat(F.lit("at/bucket"), F.col("path"))))
    recorded = digests("then").select(F.concat(F.lit("at/bucket"), F.col("path")).alias("name"), "checksum")
    return provenance.verify_outputs(recorded, now)


def _clinical_pages(spark: SparkSession, sf_dir: str) -> str:
    """Customers as clinical cases in JSON pages, with planted gaps, wrong types, unknown keys and repeats."""
    people = standins.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey")
    people = people.select("k", "c_nationkey", F.explode(F.when(F.col("k") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    k = F.col("k")
    member = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    quoted = lambda value: F.concat(F.lit('"'), value, F.lit('"'))
    days = F.when(k % 7 == 0, quoted(F.lit("unclear"))).when(k % 3 == 0, F.lit("null")).otherwise((k % 3000).cast("string"))
    demographic = F.concat_ws(
        ",",
        member("vital_status", quoted(F.when(F.col("copy") == 1, "Copy").when(k % 2 == 0, "Dead").otherwise("Alive"))),
        member("days_to_death", days),
        F.when(k % 17 == 0, member("eye_colour", F.lit("[1,2]"))),
    )
    diagnoses = F.when(k % 19 == 0, F.lit('"none"')).otherwise(
        F.concat(F.lit('[{"primary_gleason_grade":"Pattern '), F.col("c_nationkey").cast("string"), F.lit('"},{"primary_gleason_grade":"later"}]'))
    )
    case = F.concat(
        F.lit("{"),
        F.concat_ws(
            ",",
            F.when(k % 13 != 0, member("submitter_id", quoted(F.concat(F.lit("P"), k.cast("string"))))),
            F.when(k % 11 != 0, member("demographic", F.concat(F.lit("{"), demographic, F.lit("}")))),
            member("diagnoses", diagnoses),
        ),
        F.lit("}"),
    )
    pages = max(1, -(-people.count() // PAGE_ROWS))
    page = F.pmod(F.xxhash64("k"), F.lit(pages)).alias("page")
    listed = people.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("k", "copy", case.alias("case")))).alias("cases"))
    path = _path(spark, "clinical")
    body = F.concat(F.lit('{"data":{"hits":['), F.array_join("cases.case", ","), F.lit("]}}"))
    listed.select("page", body.alias("value")).write.partitionBy("page").text(path)
    return path


def clinical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clinical rows of cases with an id, first of repeated ones, wrong types as null."""
    read = repository_json.read_clinical(spark, _clinical_pages(spark, sf_dir))
    return read.where(F.col("patient").isNotNull()).select("patient", "vital_status", "days_to_death", "primary_gleason")


def clinical_json_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of the same pages by field."""
    found = repository_json.clinical_problems(spark, _clinical_pages(spark, sf_dir))
    return found.groupBy("field", "problem", "found").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("patient").alias("n_patients")).withColumn(
        "found", F.when(F.col("problem") != "duplicate_patient", F.col("found"))
    ).groupBy("field", "problem", "found").agg(F.sum("n").alias("n"), F.sum("n_patients").alias("n_patients"))


def patient_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assembled patient matrix: landed files, duplicate symbols, primary samples, first aliquots, clinical join."""
    aliquots = written(standins.aliquots(spark, sf_dir), "aliquots")
    lines = standins.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    parts = standins.table(spark, sf_dir, "part").select("p_partkey", "p_brand", (F.col("p_size") % 2).cast("long").alias("feature_pos"))
    n_lines = lines.count()
    cells = written(
        dealt(lines.join(parts, lines["l_partkey"] == parts["p_partkey"]), n_lines, "l_orderkey")
        .join(aliquots.where("o_orderkey % 97 != 0").select("barcode", "o_orderkey"), lines["l_orderkey"] == F.col("o_orderkey"))
        .groupBy("barcode", F.col("p_brand").alias("gene"), "feature_pos")
        .agg(F.sum("l_extendedprice").alias("value"))
        .withColumn("cohort_id", F.lit("orders")),
        "aliquot-cells",
    )
    clinical = harmonise.parse_barcodes(aliquots).groupBy("patient").agg(F.max("value").alias("_top")).where("_top > 200000")
    landed = dealt(lines.where("l_orderkey % 97 != 0").select("l_orderkey"), n_lines, "l_orderkey")
    tolerated = aliquots.join(landed, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").count()
    taken = assembly.require_landed(aliquots.select("barcode"), cells, tolerated)
    matrix = assembly.join_clinical(written(assembly.assemble(taken, "max_mean", "first"), "patient-cells"), clinical)
    return matrix.select("cohort_id", "gene", "sample_id", round_at(F.col("value")).alias("value"))


_CASES = """cases AS (SELECT c_custkey AS k, c_nationkey, unnest(CASE WHEN c_custkey % 10 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM customer),
named AS (SELECT *, CASE WHEN k % 13 <> 0 THEN 'P' || k END AS patient FROM cases)"""

_RANGES = f"""WITH files AS (SELECT o_orderkey % 64 AS bucket, string_agg(o_orderkey, chr(10) ORDER BY o_orderkey) || chr(10) AS body FROM orders GROUP BY 1),
cut AS (SELECT bucket, length(body) AS n_bytes, body, unnest(range(0, length(body), {RANGE_BYTES})) AS start FROM files),
leaf AS (SELECT bucket, n_bytes, start, sha256(substring(body, start + 1, {RANGE_BYTES})) AS digest FROM cut)
SELECT bucket, n_bytes, count(*) AS n_ranges, 'sha256-ranges-{RANGE_BYTES}:' || sha256(string_agg(digest, chr(10) ORDER BY start)) AS checksum
FROM leaf GROUP BY bucket, n_bytes"""

_MATRIX = f"""WITH a AS (SELECT o_orderkey, o_totalprice, o_orderstatus,
    'TCGA-' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS patient
  FROM orders JOIN customer ON o_custkey = c_custkey),
b AS (SELECT *, patient || CASE WHEN o_orderstatus = 'P' THEN '-11A-' ELSE '-01A-' END || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS barcode FROM a),
c AS (SELECT barcode, patient, o_orderstatus, p_brand AS gene, p_size % 2 AS pos, sum(l_extendedprice) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN b ON l_orderkey = o_orderkey WHERE o_orderkey % 97 <> 0 GROUP BY ALL),
w AS (SELECT gene, pos FROM c GROUP BY gene, pos QUALIFY row_number() OVER (PARTITION BY gene ORDER BY avg(value) DESC, pos) = 1),
p AS (SELECT patient, min(barcode) AS barcode FROM c JOIN w USING (gene, pos) WHERE o_orderstatus <> 'P' GROUP BY ALL),
k AS (SELECT patient FROM a GROUP BY patient HAVING max(o_totalprice) > 200000)
SELECT 'orders' AS cohort_id, c.gene, c.patient AS sample_id, {r('c.value')} AS value FROM c JOIN w USING (gene, pos)
JOIN p ON p.barcode = c.barcode SEMI JOIN k ON k.patient = c.patient"""

QUERIES = {
    "store_commits": (
        store_commits,
        f"""SELECT o_orderpriority, count(*) AS n_seen, 0::BIGINT AS n_torn, count(*) AS n_rows,
  {checksum_sql([("o_orderkey", "text"), ("o_orderpriority", "text"), ("o_custkey", "text"), ("CAST(o_totalprice AS DOUBLE)", "double"), ("o_orderstatus", "text")])} AS content_checksum,
  0::BIGINT AS n_bad_files FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_orderpriority""",
    ),
    "range_digests": (range_digests, _RANGES),
    "range_outputs": (
        range_outputs,
        """SELECT 'at/bucket' || o_orderkey % 8 AS name,
  CASE o_orderkey % 8 WHEN 1 THEN 'missing' WHEN 2 THEN 'changed' ELSE 'ok' END AS status FROM orders GROUP BY ALL""",
    ),
    "clinical_json": (
        clinical_json,
        f"""WITH {_CASES} SELECT patient, CASE WHEN k % 11 <> 0 THEN CASE WHEN k % 2 = 0 THEN 'Dead' ELSE 'Alive' END END AS vital_status,
  CASE WHEN k % 11 <> 0 AND k % 7 <> 0 AND k % 3 <> 0 THEN CAST(k % 3000 AS DOUBLE) END AS days_to_death,
  CASE WHEN k % 19 <> 0 THEN 'Pattern ' || c_nationkey END AS primary_gleason FROM named WHERE copy = 0 AND patient IS NOT NULL""",
    ),
    "clinical_json_problems": (
        clinical_json_problems,
        f"""WITH {_CASES}, f AS (
  SELECT 'submitter_id' AS field, 'missing_patient' AS problem, NULL AS found, patient FROM named WHERE patient IS NULL
  UNION ALL SELECT 'submitter_id', 'duplicate_patient', NULL, patient FROM named WHERE copy = 1 AND patient IS NOT NULL
  UNION ALL SELECT 'days_to_death', 'mistyped', '"unclear"', patient FROM named WHERE k % 7 = 0 AND k % 11 <> 0
  UNION ALL SELECT 'diagnoses', 'mistyped', '"none"', patient FROM named WHERE k % 19 = 0
  UNION ALL SELECT 'demographic.eye_colour', 'unknown_field', '[1,2]', patient FROM named WHERE k % 17 = 0 AND k % 11 <> 0)
SELECT field, problem, found, count(*) AS n, count(DISTINCT patient) AS n_patients FROM f GROUP BY ALL""",
    ),
    "patient_matrix": (patient_matrix, _MATRIX),
}
