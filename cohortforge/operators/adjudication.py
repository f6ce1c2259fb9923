"""Longitudinal event adjudication over clinical observation records.

One row per observation; every verdict is a combinable aggregate per patient,
so a patient with very many records is never gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortforge.functions import text
from cohortforge.functions.hashing import population_hash

# Field names of the observation records and the horizon.
FLAG_FIELD = "biochemical_recurrence"
DAY_FIELDS = (
    "days_to_first_biochemical_recurrence",
    "days_to_second_biochemical_recurrence",
    "days_to_third_biochemical_recurrence",
)
TYPE_FIELDS = ("new_neoplasm_event_type", "type_ofprogression_of_disease_ht")
NEGATIVE_FIELDS = ("biochemical_recurrence", "new_tumor_event_after_initial_treatment")
CONTACT_FIELD = "days_to_last_followup"
EVENT_WORD = "biochemical"
CAP_MONTHS = 60.0

COUNT_NAMES = (
    "n_source", "n_explicit_bcr", "n_timed_bcr", "n_untimed_bcr_excluded",
    "n_supported_censored", "n_unknown_excluded", "n_no_negative_evidence",
    "n_negative_without_time", "n_before_expression_match", "n_events_before_cap",
    "n_events_after_cap", "n_censored_by_cap", "n_followup_capped",
)


def flag_records(records: DataFrame) -> DataFrame:
    """Per-record evidence flags and usable days.

    Fields are arrays of nullable strings; an absent field counts as empty.
    A populated day field is evidence even when it is no usable number.
    """

    def field(name: str):
        if name in records.columns:
            return F.col(name)
        return F.array().cast("array<string>")

    evidence = F.array_contains(text.populated(field(FLAG_FIELD)), "YES")
    for name in TYPE_FIELDS:
        evidence = evidence | text.mentions(field(name), EVENT_WORD)
    for name in DAY_FIELDS:
        evidence = evidence | (F.size(text.populated(field(name))) > 0)
    negative = F.lit(False)
    for name in NEGATIVE_FIELDS:
        negative = negative | F.array_contains(text.populated(field(name)), "NO")
    days = text.positive_days(field(DAY_FIELDS[0]))
    return records.select(
        "patient",
        "record",
        evidence.alias("is_evidence"),
        negative.alias("is_negative"),
        F.array_min(days).alias("first_day"),
        F.array_max(days).alias("last_first_day"),
        F.array_max(text.positive_days(field(CONTACT_FIELD))).alias("contact_day"),
    )


def adjudicate(records: DataFrame) -> DataFrame:
    """One verdict row per patient, the excluded ones included.

    With evidence: the earliest valid first-event day, else excluded (never
    censored).  Without: the latest valid contact day of a negative record, else
    excluded.  The event counts only up to the horizon; time is capped at it.
    """
    flags = flag_records(records)
    first = F.when(F.col("first_day").isNotNull(), F.struct("first_day", "record"))
    supported = F.when(
        F.col("is_negative") & F.col("contact_day").isNotNull(), F.struct("contact_day", "record")
    )
    per_patient = flags.groupBy("patient").agg(
        F.bool_or("is_evidence").alias("_evidence"),
        F.bool_or("is_negative").alias("_negative"),
        F.min(first).alias("_first"),
        F.max(supported).alias("_supported"),
        F.max("last_first_day").alias("_last_first"),
        F.count_if(F.col("is_evidence") | F.col("is_negative")).alias("n_conflict_records"),
        F.count_if(F.col("first_day").isNotNull()).alias("n_day_records"),
        F.count(F.lit(1)).alias("n_records"),
    )
    timed = F.col("_evidence") & F.col("_first").isNotNull()
    censored = ~F.col("_evidence") & F.col("_supported").isNotNull()
    day = F.when(timed, F.col("_first.first_day")).when(censored, F.col("_supported.contact_day"))
    uncapped = F.when(timed, 1).when(censored, 0)
    months = F.col("time_days") / text.ADJUDICATION_DAYS_PER_MONTH
    return (
        per_patient.withColumn("time_days", day)
        .withColumn("event_uncapped", uncapped)
        .select(
            "patient",
            F.col("event_uncapped").isNotNull().alias("included"),
            F.col("event_uncapped").cast("int").alias("event_uncapped"),
            F.when(
                F.col("event_uncapped").isNotNull(),
                ((F.col("event_uncapped") == 1) & (months <= CAP_MONTHS)).cast("int"),
            ).alias("event"),
            "time_days",
            months.alias("time_months_uncapped"),
            F.when(months > CAP_MONTHS, F.lit(CAP_MONTHS)).otherwise(months).alias("time_months"),
            F.when(timed, F.col("_first.record"))
            .when(censored, F.col("_supported.record"))
            .alias("selected_record"),
            F.when(timed, "earliest_valid_first_bcr")
            .when(F.col("_evidence"), "explicit_bcr_without_valid_first_bcr_day")
            .when(censored, "latest_supported_negative_contact")
            .when(F.col("_negative"), "negative_without_valid_contact")
            .otherwise("unknown_bcr_status")
            .alias("reason"),
            (F.col("_evidence") & F.col("_negative")).alias("conflicting_status"),
            F.coalesce(F.col("_first.first_day") != F.col("_last_first"), F.lit(False)).alias(
                "differing_days"
            ),
            F.col("_evidence").alias("has_evidence"),
            "n_conflict_records",
            "n_day_records",
            "n_records",
        )
    )


def counts(verdicts: DataFrame) -> DataFrame:
    """The adjudication counts as one row."""
    reason = F.col("reason")
    ev, capped = F.col("event_uncapped"), F.col("event")
    return verdicts.agg(
        F.count(F.lit(1)).alias("n_source"),
        F.count_if("has_evidence").alias("n_explicit_bcr"),
        F.count_if(ev == 1).alias("n_timed_bcr"),
        F.count_if(reason == "explicit_bcr_without_valid_first_bcr_day").alias("n_untimed_bcr_excluded"),
        F.count_if(ev == 0).alias("n_supported_censored"),
        F.count_if(reason.isin("negative_without_valid_contact", "unknown_bcr_status")).alias("n_unknown_excluded"),
        F.count_if(reason == "unknown_bcr_status").alias("n_no_negative_evidence"),
        F.count_if(reason == "negative_without_valid_contact").alias("n_negative_without_time"),
        F.count_if("included").alias("n_before_expression_match"),
        F.count_if(ev == 1).alias("n_events_before_cap"),
        F.count_if(capped == 1).alias("n_events_after_cap"),
        F.count_if((ev == 1) & (capped == 0)).alias("n_censored_by_cap"),
        F.count_if((ev == 0) & (F.col("time_months_uncapped") > CAP_MONTHS)).alias("n_followup_capped"),
    )


def matched_counts(verdicts: DataFrame, patients: DataFrame) -> DataFrame:
    """Counts restricted to patients that also have expression."""
    shared = verdicts.filter("included").join(patients.select("patient"), "patient", "left_semi")
    ev, capped = F.col("event_uncapped"), F.col("event")
    return shared.agg(
        F.count(F.lit(1)).alias("n_after_expression_match"),
        F.count_if(ev == 1).alias("n_matched_events_before_cap"),
        F.count_if(capped == 1).alias("n_matched_events_after_cap"),
        F.count_if((ev == 1) & (capped == 0)).alias("n_matched_censored_by_cap"),
    )


def as_metrics(counts_row: DataFrame) -> DataFrame:
    """One-row counts as (metric, n) rows."""
    return counts_row.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("metric"), F.col(c).alias("n"))
                    for c in counts_row.columns
                ]
            )
        )
    )


def conflicts(verdicts: DataFrame) -> DataFrame:
    """Patients whose records disagree, by kind of conflict."""
    kinds = F.array_compact(
        F.array(
            F.when(
                F.col("conflicting_status"),
                F.struct(
                    F.lit("positive_and_negative_observations").alias("kind"),
                    F.col("n_conflict_records").alias("n_records"),
                ),
            ),
            F.when(
                F.col("differing_days"),
                F.struct(
                    F.lit("differing_first_bcr_days").alias("kind"),
                    F.col("n_day_records").alias("n_records"),
                ),
            ),
        )
    )
    return verdicts.select("patient", F.inline(kinds))


def ledger(records: DataFrame) -> DataFrame:
    """Every record with its flags and its patient's verdict: the audit trail as rows."""
    verdicts = adjudicate(records).select(
        "patient", "included", "selected_record", "reason", "event_uncapped", "event"
    )
    return flag_records(records).join(verdicts, "patient").withColumn(
        "selected", F.coalesce(F.col("record") == F.col("selected_record"), F.lit(False))
    )


def record_problems(records: DataFrame) -> DataFrame:
    """Refusals: blank identities, duplicate observations, conflicting source checksums."""
    blank = records.filter(
        (F.coalesce(F.trim("patient"), F.lit("")) == "")
        | (F.coalesce(F.trim("record"), F.lit("")) == "")
        | (F.coalesce(F.trim("checksum"), F.lit("")) == "")
    ).select(F.lit("missing_identity").alias("problem"), F.coalesce("patient", F.lit("")).alias("key"))
    duplicate = (
        records.groupBy("patient", "record").count().filter(F.col("count") > 1)
        .select(F.lit("duplicate_observation"), F.concat_ws("/", "patient", "record"))
    )
    clashing = (
        records.groupBy("source")
        .agg(F.min("checksum").alias("_a"), F.max("checksum").alias("_b"))
        .filter(F.col("_a") != F.col("_b"))
        .select(F.lit("conflicting_source_checksum"), F.col("source"))
    )
    return blank.union(duplicate).union(clashing)


def snapshot_checksum(records: DataFrame) -> DataFrame:
    """Identity of a source snapshot: hash of the sorted per-file digests.

    Independent of file names and layout; very large snapshots hash in buckets.
    """
    digests = records.select(F.lit("snapshot").alias("_s"), "checksum").distinct()
    return population_hash(digests, ["_s"], "checksum", out="snapshot_checksum").select("snapshot_checksum")
