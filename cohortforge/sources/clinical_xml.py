"""Clinical XML files: one patient each, with enrolment and follow-up observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortforge.functions.hashing import tagged_sha
from cohortforge.operators.adjudication import (
    CONTACT_FIELD,
    DAY_FIELDS,
    FLAG_FIELD,
    NEGATIVE_FIELDS,
    TYPE_FIELDS,
)

FIELDS = list(dict.fromkeys([FLAG_FIELD, *DAY_FIELDS, *TYPE_FIELDS, *NEGATIVE_FIELDS, CONTACT_FIELD]))
REQUIRED = [FLAG_FIELD, DAY_FIELDS[0], CONTACT_FIELD]
_LEAF = T.ArrayType(
    T.StructType(
        [T.StructField("_VALUE", T.StringType()), T.StructField("_procurement_status", T.StringType())]
    )
)


def _schema(extra: list[str]) -> T.StructType:
    names = [*FIELDS, *[e for e in extra if e not in FIELDS]]
    leaves = [T.StructField(n, _LEAF) for n in names]
    follow = T.StructType([T.StructField("bcr_followup_barcode", _LEAF), *leaves])
    return T.StructType(
        [
            T.StructField("bcr_patient_barcode", _LEAF),
            *leaves,
            T.StructField("follow_ups", T.StructType([T.StructField("follow_up", T.ArrayType(follow))])),
        ]
    )


def read_records(spark: SparkSession, path: str, extra_fields: list[str] | None = None) -> DataFrame:
    """Observation records: patient, record, kind, one array column per field, source, checksum.

    Repeated values keep their order, and each field has a ``<field>__status``
    column with the procurement status of every value.  Follow-up fields are
    never merged into the enrolment record.
    """
    schema = _schema(extra_fields or [])
    names = [f.name for f in schema if f.name not in ("bcr_patient_barcode", "follow_ups")]
    parsed = (
        spark.read.format("xml").option("rowTag", "patient").option("ignoreNamespace", True)
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml")
        .schema(schema).load(path)
        .withColumn("source", F.col("_metadata.file_path"))
    )
    leaves = lambda prefix: [
        c
        for n in names
        for c in (
            F.col(f"{prefix}{n}._VALUE").alias(n),
            F.col(f"{prefix}{n}._procurement_status").alias(f"{n}__status"),
        )
    ]
    patient = F.trim(F.get(F.col("bcr_patient_barcode._VALUE"), F.lit(0))).alias("patient")
    enrolment = parsed.select(
        patient, F.lit("enrollment").alias("record"), F.lit("enrollment").alias("kind"), *leaves(""), "source"
    )
    follow = parsed.select(patient, "source", F.explode("follow_ups.follow_up").alias("f"))
    follow_ups = follow.select(
        "patient",
        F.get(F.col("f.bcr_followup_barcode._VALUE"), F.lit(0)).alias("record"),
        F.lit("follow_up").alias("kind"),
        *leaves("f."),
        "source",
    )
    digests = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml")
        .load(path).select(F.col("path").alias("_path"), tagged_sha(F.col("content")).alias("checksum"))
    )
    key = lambda c: F.regexp_replace(c, "^file:/+", "/")
    both = enrolment.unionByName(follow_ups)
    return both.join(digests, key(F.col("source")) == key(F.col("_path"))).drop("_path")


def file_problems(spark: SparkSession, path: str) -> DataFrame:
    """Refused files: declarations, no or several patients, missing ids or required fields."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml")
        .load(path).select(F.col("path").alias("source"), F.decode("content", "UTF-8").alias("text"))
    )
    opening = lambda tag: F.size(F.regexp_extract_all("text", F.lit(rf"<(?:\w+:)?{tag}[\s>/]"), F.lit(0)))
    lacking = F.lit(False)
    for name in REQUIRED:
        lacking = lacking | (opening(name) == 0)
    ids = F.regexp_extract_all("text", F.lit(r"<(?:\w+:)?bcr_patient_barcode[^>]*>\s*([^<\s][^<]*)<"), F.lit(1))
    follow_ids = F.size(F.regexp_extract_all("text", F.lit(r"<(?:\w+:)?bcr_followup_barcode[^>]*>\s*[^<\s]"), F.lit(0)))
    upper = F.upper("text")
    code = (
        F.when(F.contains(upper, F.lit("<!DOCTYPE")) | F.contains(upper, F.lit("<!ENTITY")), "declaration")
        .when(opening("patient") != 1, "not_exactly_one_patient")
        .when(F.size(ids) == 0, "missing_patient_barcode")
        .when(opening("follow_up") != follow_ids, "missing_followup_barcode")
        .when(lacking, "missing_required_field")
    )
    flagged = files.select("source", code.alias("problem"), F.trim(F.get(ids, F.lit(0))).alias("patient"))
    repeated = (
        flagged.filter(F.col("patient").isNotNull()).groupBy("patient")
        .agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select("patient")
    )
    duplicates = flagged.join(repeated, "patient", "left_semi").select(
        "source", F.lit("duplicate_patient").alias("problem")
    )
    return flagged.filter(F.col("problem").isNotNull()).select("source", "problem").unionByName(duplicates)
