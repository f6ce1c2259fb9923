"""File-manifest and clinical JSON responses of a data repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortforge.functions.text import barcode_patient
from cohortforge.operators.endpoints import first_per_key

_ALIQUOT = "array<struct<submitter_id:string>>"
_ANALYTE = f"array<struct<aliquots:{_ALIQUOT}>>"
_PORTION = f"array<struct<analytes:{_ANALYTE}>>"
_SAMPLE = f"array<struct<sample_type:string,portions:{_PORTION}>>"
_FILE_HIT = (
    "array<struct<file_id:string,file_name:string,file_size:bigint,md5sum:string,"
    f"analysis:struct<workflow_type:string>,cases:array<struct<samples:{_SAMPLE}>>>>"
)
# Clinical fields of a case, with path, type and column name.
CASE_FIELDS = [
    ("$.demographic.vital_status", "string", "vital_status"),
    ("$.demographic.days_to_death", "double", "days_to_death"),
    ("$.demographic.age_at_index", "double", "age_at_index"),
    ("$.diagnoses[0].days_to_last_follow_up", "double", "days_to_last_follow_up"),
    ("$.diagnoses[0].primary_gleason_grade", "string", "primary_gleason"),
    ("$.diagnoses[0].secondary_gleason_grade", "string", "secondary_gleason"),
    ("$.diagnoses[0].ajcc_pathologic_t", "string", "ajcc_t"),
    ("$.diagnoses[0].ajcc_pathologic_n", "string", "ajcc_n"),
]
# Objects of a case and the JSON type each must have.
CASE_PARTS = [("$", "OBJECT"), ("$.demographic", "OBJECT"), ("$.diagnoses", "ARRAY"), ("$.diagnoses[0]", "OBJECT")]


def _hits(spark: SparkSession, path: str, hit: str) -> DataFrame:
    raw = spark.read.schema(f"data struct<hits:{hit}>, hits {hit}").option("multiLine", True).json(path)
    return raw.select(
        F.col("_metadata.file_path").alias("source"),
        F.posexplode_outer(F.coalesce("data.hits", "hits")).alias("pos", "hit"),
    )


def _first_of(arr: Column) -> Column:
    return F.get(arr, F.lit(0))


def _last_first_aliquot(samples: Column) -> Column:
    """First aliquot of the last analyte that has one, over all portions."""
    empty = F.array().cast("array<string>")
    portions = _first_of(samples)["portions"]
    per_portion = F.transform(
        portions,
        lambda p: F.transform(p["analytes"], lambda a: _first_of(a["aliquots"])["submitter_id"]),
    )
    flat = F.flatten(F.filter(per_portion, lambda x: x.isNotNull()))
    return F.try_element_at(F.coalesce(F.array_compact(flat), empty), F.lit(-1))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per file, with an ``error_code`` where a file cannot be tied to a patient."""
    hits = _hits(spark, path, _FILE_HIT)
    case = _first_of(F.col("hit.cases"))
    rows = hits.select(
        "source",
        F.col("hit.file_id").alias("file_id"),
        F.col("hit.file_name").alias("file_name"),
        F.col("hit.file_size").alias("file_size"),
        F.col("hit.md5sum").alias("md5sum"),
        _last_first_aliquot(case["samples"]).alias("barcode"),
        _first_of(case["samples"])["sample_type"].alias("sample_type"),
        F.col("hit.analysis.workflow_type").alias("workflow"),
        F.when(F.col("hit").isNull(), "no_files").when(case.isNull(), "no_case").alias("_code"),
    )
    counts = rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("_n"))
    parsed = rows.join(counts, "file_id", "left").withColumn("patient", barcode_patient(F.col("barcode")))
    code = (
        F.when(F.col("_code").isNotNull(), F.col("_code"))
        .when(F.coalesce(F.col("barcode"), F.lit("")) == "", "no_barcode")
        .when(F.col("patient").isNull(), "malformed_barcode")
        .when(F.col("_n") > 1, "duplicate_file")
    )
    return parsed.withColumn("error_code", code).drop("_n", "_code")


def _cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases as variants: whatever JSON they hold survives the scan."""
    raw = spark.read.format("json").option("singleVariantColumn", "doc").option("multiLine", True).load(path)
    lists = [F.try_variant_get("doc", at, "array<variant>") for at in ("$.data.hits", "$.hits")]
    cases = raw.select(F.col("_metadata.file_path").alias("source"), F.posexplode(F.coalesce(*lists)).alias("pos", "hit"))
    return cases.withColumn("patient", F.try_variant_get("hit", "$.submitter_id", "string"))


def read_clinical(spark: SparkSession, path: str) -> DataFrame:
    """One row per patient; the first row of a duplicated patient, first diagnosis only.

    A field of another type than it should have is null, and no other field suffers
    (``clinical_problems`` names it). Cases without an id share the row of the null patient.
    """
    fields = [F.try_variant_get("hit", at, kind).alias(name) for at, kind, name in CASE_FIELDS]
    rows = _cases(spark, path).select("patient", F.struct("source", "pos").alias("_order"), *fields)
    return first_per_key(rows, ["patient"], "_order").drop("_order")


def clinical_problems(spark: SparkSession, path: str) -> DataFrame:
    """What ``read_clinical`` could not take: (source, pos, patient, field, problem, found).

    ``missing_patient``; ``duplicate_patient`` for each case after a patient's first;
    ``mistyped`` for a value that is there but not of the field's type; ``unknown_field``
    for keys next to the known ones in the demographic part and the first diagnosis.
    ``found`` is the offending JSON.
    """
    cases = _cases(spark, path)
    checks = [
        F.when(F.col("patient").isNull(), _problem("submitter_id", "missing_patient", None)),
        *[_mistyped(at, name, F.try_variant_get("hit", at, kind).isNull()) for at, kind, name in CASE_FIELDS],
        *[_mistyped(at, at.lstrip("$.") or "case", ~_kind_of(at).startswith(kind)) for at, kind in CASE_PARTS],
    ]
    unknown = F.concat(*[_unknown(part) for part in ("$.demographic", "$.diagnoses[0]")])
    found = F.inline(F.concat(F.array_compact(F.array(*checks)), unknown))
    own = cases.select("source", "pos", "patient", found)
    firsts = cases.where(F.col("patient").isNotNull()).groupBy("patient").agg(F.min(F.struct("source", "pos")).alias("_first"))
    again = cases.join(firsts, "patient").where(F.struct("source", "pos") != F.col("_first"))
    return own.unionByName(again.select("source", "pos", "patient", F.inline(F.array(_problem("submitter_id", "duplicate_patient", "patient")))))


def _problem(field: str, problem: str, found: Column | str | None) -> Column:
    value = F.lit(None) if found is None else F.col(found) if isinstance(found, str) else found
    return F.struct(F.lit(field).alias("field"), F.lit(problem).alias("problem"), value.cast("string").alias("found"))


def _kind_of(at: str) -> Column:
    return F.schema_of_variant(F.try_variant_get("hit", at, "variant"))


def _mistyped(at: str, name: str, wrong: Column) -> Column:
    value = F.try_variant_get("hit", at, "variant")
    there = value.isNotNull() & ~F.coalesce(F.is_variant_null(value), F.lit(True))
    return F.when(there & wrong, _problem(name, "mistyped", F.to_json(value)))


def _unknown(part: str) -> Column:
    known = [at.removeprefix(f"{part}.") for at, _, _ in CASE_FIELDS if at.startswith(f"{part}.")]
    entries = F.map_entries(F.try_variant_get("hit", part, "map<string,variant>"))
    extra = F.filter(entries, lambda e: ~e["key"].isin(known))
    rows = F.transform(
        extra,
        lambda e: F.struct(
            F.concat(F.lit(f"{part.lstrip('$.')}."), e["key"]).alias("field"),
            F.lit("unknown_field").alias("problem"),
            F.to_json(e["value"]).alias("found"),
        ),
    )
    return F.coalesce(rows, F.array().cast("array<struct<field:string,problem:string,found:string>>"))
