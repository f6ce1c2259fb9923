"""Registered queries: endpoints, filters, analysis set and adjudication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortforge.catalogue.base_sql import X1, X6, X7, r
from cohortforge.functions.numeric import round_at
from cohortforge.functions.staging import literal_rows, written
from cohortforge.operators import adjudication, endpoints
from cohortforge.plans import standins

RULES = [
    {"column": "status", "drop": ["p"]},
    {"column": "nation", "drop": ["3", "NaN"]},
    {"column": "nation", "keep": [str(i) for i in range(1, 25)]},
    {"column": "nation", "drop_contains": ["2"]},
]


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One endpoint declaration per segment found in the data."""
    cohorts = standins.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("cohort_id")).distinct()
    declared = literal_rows(
        spark, [("time", "status", "followup", "days", ["F"], ["O"], 60.0)],
        endpoints.SPEC_SCHEMA.replace("cohort_id string, ", ""),
    )
    row = declared.agg(F.first(F.struct("*"))).scalar()
    return written(cohorts.withColumn("_s", row).select("cohort_id", "_s.*"), "specs")


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return endpoints.derive(standins.clinical_raw(spark, sf_dir), specs(spark, sf_dir))


def endpoint_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir).select(
        "cohort_id", "sample_id", round_at(F.col("time_months")).alias("time_months"), "event"
    )


def endpoint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        endpoints.report(derived(spark, sf_dir))
        .withColumn("event_rate", round_at(F.col("event_rate")))
        .withColumn("unrecognised", F.array_join("unrecognised", ","))
    )


def _cdr_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as an endpoint table: several rows per patient, days, five projects."""
    orders = standins.table(spark, sf_dir, "orders")
    customers = standins.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.substring("c_mktsegment", 1, 4).alias("type")
    )
    event = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0)
    return orders.join(customers, "o_custkey").select(
        F.col("o_orderkey").alias("line_no"),
        F.col("o_custkey").cast("string").alias("bcr_patient_barcode"),
        "type",
        event.alias("PFI"),
        F.floor(F.col("o_totalprice") / 200 - 50).alias("PFI.time"),
    )


def endpoint_cdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = endpoints.cdr_endpoint(_cdr_table(spark, sf_dir), "TCGA-BUIL", "PFI")
    return out.select("sample_id", round_at(F.col("time_months")).alias("time_months"), "event")


def endpoint_cdr_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return endpoints.cdr_report(endpoints.cdr_endpoint(_cdr_table(spark, sf_dir), "TCGA-BUIL", "PFI"))


def endpoint_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = standins.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("s"),
        F.date_diff(F.max("o_orderdate"), F.min("o_orderdate")).alias("span"),
        F.max("o_totalprice").alias("top"),
    )
    clinical = per.select(
        F.col("o_custkey").cast("string").alias("sample_id"),
        F.when(F.col("s") == "F", "Dead").when(F.col("s") == "O", "Alive").alias("vital_status"),
        F.when(F.col("top") > 150000, F.col("span").cast("string")).otherwise("--").alias("days_to_death"),
        (F.col("span") + 10).cast("string").alias("days_to_last_follow_up"),
    )
    out = endpoints.overall_survival(clinical)
    return out.select("sample_id", round_at(F.col("time_months")).alias("time_months"), "event")


def sample_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = endpoints.filter_report(standins.clinical_raw(spark, sf_dir), RULES)
    return out.select("cohort_id", "rule_no", "n_before", "n_after", "n_dropped")


def filtered_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return endpoints.apply_filters(standins.clinical_raw(spark, sf_dir), RULES).select("cohort_id", "sample_id")


def excluded_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = endpoints.excluded_samples(standins.clinical_raw(spark, sf_dir), RULES)
    return out.select("cohort_id", "sample_id", "rule_no")


def endpoint_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by customer, some for advised-against or unknown endpoints."""
    k = F.col("c_custkey")
    pick = lambda names, at: F.get(F.array(*[F.lit(n) for n in names]), (at % len(names)).cast("int"))
    requests = standins.table(spark, sf_dir, "customer").select(
        "c_custkey",
        pick(["TCGA-PRAD", "thca", "LGG", "BRCA"], k).alias("project"),
        pick(["OS", "DSS", "DFI", "PFI", "RFS"], k).alias("endpoint"),
        (k % 3 == 0).alias("allow_discouraged"),
    )
    return endpoints.endpoint_problems(requests).groupBy("project", "endpoint", "problem").agg(F.count(F.lit(1)).alias("n"))


def analysis_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = endpoints.analysis_set(derived(spark, sf_dir))
    return kept.select(
        "cohort_id", "sample_id", round_at(F.col("time_months")).alias("time_months"), "event"
    )


def align_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return endpoints.align_counts(standins.expression(spark, sf_dir), derived(spark, sf_dir))


def inspect_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = endpoints.inspect_attributes(standins.clinical_raw(spark, sf_dir))
    return out.select(
        "cohort_id", "column", "n_present", F.array_join("examples", ",").alias("examples")
    )


def adjudicate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = adjudication.adjudicate(standins.observations(spark, sf_dir))
    return out.select(
        "patient",
        F.col("included").cast("int").alias("included"),
        "event_uncapped",
        "event",
        round_at(F.col("time_days")).alias("time_days"),
        round_at(F.col("time_months")).alias("time_months"),
        "selected_record",
        "reason",
    )


def adjudication_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = adjudication.adjudicate(standins.observations(spark, sf_dir))
    patients = standins.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("patient"))
    both = adjudication.as_metrics(adjudication.counts(verdicts)).unionByName(
        adjudication.as_metrics(adjudication.matched_counts(verdicts, patients))
    )
    return both


def adjudication_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjudication.conflicts(adjudication.adjudicate(standins.observations(spark, sf_dir)))


_REPORT = f"""
WITH {X6},
f AS (SELECT *, time_months IS NOT NULL AND event IS NOT NULL AS usable, event_uncapped IS NULL AS unparsed FROM ep)
SELECT cohort_id, count(*) AS n_input, count(*) FILTER (usable) AS n_usable,
       count(*) FILTER (usable AND event = 1) AS n_events,
       count(*) FILTER (NOT usable AND NOT unparsed) AS n_dropped_missing,
       count(*) FILTER (unparsed) AS n_unparsed_event,
       count(*) FILTER (event_uncapped = 1 AND time_uncapped > 60) AS n_censored_by_cap,
       count(*) FILTER (coalesce(from_followup, false)) AS n_time_from_followup,
       {r('count(*) FILTER (usable AND event = 1) * 1e0 / count(*) FILTER (usable)')} AS event_rate,
       coalesce(string_agg(DISTINCT status, ',') FILTER (unparsed), '') AS unrecognised
FROM f GROUP BY 1"""

_CDR = """
cdr AS (
  SELECT CAST(o_custkey AS VARCHAR) AS sample_id, o_orderkey,
         CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS e, floor(o_totalprice / 200 - 50) / 30.4375e0 AS t
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment LIKE 'BUIL%'
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1)"""

_OVERALL = f"""
WITH p AS (SELECT CAST(o_custkey AS VARCHAR) AS sample_id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS s,
                  date_diff('day', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE))) AS span, max(o_totalprice) AS top
           FROM orders GROUP BY 1)
SELECT sample_id, CAST(s = 'F' AS INTEGER) AS event,
       {r("CASE WHEN s = 'F' THEN CASE WHEN top > 150000 THEN span / 30.4375e0 END ELSE (span + 10) / 30.4375e0 END")} AS time_months
FROM p"""

_FILTERS = f"""
WITH {X6},
f AS (SELECT cohort_id, sample_id, status <> 'P' AS p1,
             c_nationkey % 7 <> 0 AND c_nationkey <> 3 AS p2,
             c_nationkey BETWEEN 1 AND 24 AND c_nationkey % 7 <> 0 AS p3,
             position('2' IN CAST(c_nationkey AS VARCHAR)) = 0 OR c_nationkey % 7 = 0 AS p4
      FROM x6)"""

_FILTER_REPORT = _FILTERS + """,
c AS (SELECT cohort_id, count(*) AS n0, count(*) FILTER (p1) AS n1, count(*) FILTER (p1 AND p2) AS n2,
             count(*) FILTER (p1 AND p2 AND p3) AS n3, count(*) FILTER (p1 AND p2 AND p3 AND p4) AS n4
      FROM f GROUP BY 1)
SELECT cohort_id, 1 AS rule_no, n0 AS n_before, n1 AS n_after, n0 - n1 AS n_dropped FROM c
UNION ALL SELECT cohort_id, 2, n1, n2, n1 - n2 FROM c
UNION ALL SELECT cohort_id, 3, n2, n3, n2 - n3 FROM c
UNION ALL SELECT cohort_id, 4, n3, n4, n3 - n4 FROM c"""

_ALIGN = f"""
WITH {X1}, {X6},
m AS (SELECT DISTINCT cohort_id, sample_id FROM x1),
j AS (SELECT coalesce(m.cohort_id, ep.cohort_id) AS cohort_id, coalesce(m.sample_id, ep.sample_id) AS sample_id,
             m.sample_id IS NOT NULL AS x, ep.sample_id IS NOT NULL AS c,
             coalesce(time_months > 0 AND event IN (0, 1), false) AS a, event
      FROM m FULL JOIN ep ON m.cohort_id = ep.cohort_id AND m.sample_id = ep.sample_id)
SELECT cohort_id, count(*) FILTER (x) AS n_expression, count(*) FILTER (c) AS n_clinical,
       count(*) FILTER (x AND c) AS n_aligned, count(*) FILTER (x AND c AND a) AS n_analysis,
       count(*) FILTER (x AND c AND a AND event = 1) AS n_events,
       CASE WHEN count(*) FILTER (x AND c AND a) > 0 THEN
         'sha256:' || sha256(string_agg(sample_id, chr(10) ORDER BY sample_id) FILTER (x AND c AND a)) END AS population_hash
FROM j GROUP BY 1"""

_INSPECT = f"""
WITH {X6},
kv AS (SELECT cohort_id, 'status' AS k, status AS v FROM x6
       UNION ALL SELECT cohort_id, 'time', CASE WHEN status = 'F' THEN span || ' days' END FROM x6
       UNION ALL SELECT cohort_id, 'followup', CASE WHEN status <> 'F' THEN span || ' days' END FROM x6
       UNION ALL SELECT cohort_id, 'nation', CASE WHEN c_nationkey % 7 <> 0 THEN CAST(c_nationkey AS VARCHAR) END FROM x6),
ex AS (SELECT cohort_id, k, v FROM (SELECT DISTINCT cohort_id, k, v FROM kv WHERE v IS NOT NULL)
       QUALIFY row_number() OVER (PARTITION BY cohort_id, k ORDER BY v) <= 3),
n AS (SELECT cohort_id, k, count(v) AS n_present FROM kv GROUP BY 1, 2),
s AS (SELECT cohort_id, k, string_agg(v, ',' ORDER BY v) AS examples FROM ex GROUP BY 1, 2)
SELECT cohort_id, k AS "column", n_present, examples FROM n LEFT JOIN s USING (cohort_id, k)"""

_VERDICT = f"""
WITH {X7},
fl AS (SELECT patient, record, coalesce(flag = 'YES', false) OR first_day IS NOT NULL AS evd,
              coalesce(flag = 'NO', false) AS neg,
              CASE WHEN TRY_CAST(first_day AS DOUBLE) > 0 THEN TRY_CAST(first_day AS DOUBLE) END AS fd,
              CASE WHEN contact_day > 0 THEN contact_day END AS cd
       FROM x7),
g AS (SELECT patient, bool_or(evd) AS evd, bool_or(neg) AS neg,
             min(fd) AS fd, arg_min(record, (fd, record)) FILTER (fd IS NOT NULL) AS fr,
             max(cd) FILTER (neg) AS cd, arg_max(record, (cd, record)) FILTER (neg AND cd IS NOT NULL) AS cr,
             max(fd) AS lfd, count(*) FILTER (evd OR neg) AS nc, count(fd) AS nd
      FROM fl GROUP BY 1),
v AS (SELECT *, CASE WHEN evd AND fd IS NOT NULL THEN 1 WHEN NOT evd AND cd IS NOT NULL THEN 0 END AS eu,
             CASE WHEN evd THEN fd ELSE cd END AS day FROM g),
w AS (SELECT *, day / 30.44e0 AS months,
             CASE WHEN eu IS NOT NULL THEN CAST(eu = 1 AND day / 30.44e0 <= 60 AS INTEGER) END AS ec,
             CASE WHEN evd AND fd IS NOT NULL THEN 'earliest_valid_first_bcr'
                  WHEN evd THEN 'explicit_bcr_without_valid_first_bcr_day'
                  WHEN cd IS NOT NULL THEN 'latest_supported_negative_contact'
                  WHEN neg THEN 'negative_without_valid_contact' ELSE 'unknown_bcr_status' END AS reason
      FROM v)"""

_ADJUDICATE = f"""{_VERDICT}
SELECT patient, CAST(eu IS NOT NULL AS INTEGER) AS included, eu AS event_uncapped, ec AS event,
       {r('day')} AS time_days, {r('CASE WHEN months > 60 THEN 60e0 ELSE months END')} AS time_months,
       CASE WHEN eu = 1 THEN fr WHEN eu = 0 THEN cr END AS selected_record, reason
FROM w"""

_METRICS = {
    "n_source": "true",
    "n_explicit_bcr": "evd",
    "n_timed_bcr": "eu = 1",
    "n_untimed_bcr_excluded": "evd AND eu IS NULL",
    "n_supported_censored": "eu = 0",
    "n_unknown_excluded": "NOT evd AND eu IS NULL",
    "n_no_negative_evidence": "NOT evd AND eu IS NULL AND NOT neg",
    "n_negative_without_time": "NOT evd AND eu IS NULL AND neg",
    "n_before_expression_match": "eu IS NOT NULL",
    "n_events_before_cap": "eu = 1",
    "n_events_after_cap": "ec = 1",
    "n_censored_by_cap": "eu = 1 AND ec = 0",
    "n_followup_capped": "eu = 0 AND months > 60",
    "n_after_expression_match": "eu IS NOT NULL AND matched",
    "n_matched_events_before_cap": "eu = 1 AND matched",
    "n_matched_events_after_cap": "ec = 1 AND matched",
    "n_matched_censored_by_cap": "eu = 1 AND ec = 0 AND matched",
}
_COUNTS = f"""{_VERDICT},
x AS (SELECT *, patient IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer) AS matched FROM w)
""" + "\nUNION ALL ".join(
    f"SELECT '{name}' AS metric, count(*) FILTER ({cond}) AS n FROM x" for name, cond in _METRICS.items()
)

_CONFLICTS = f"""{_VERDICT}
SELECT patient, 'positive_and_negative_observations' AS kind, nc AS n_records FROM w WHERE evd AND neg
UNION ALL SELECT patient, 'differing_first_bcr_days', nd FROM w WHERE fd <> lfd"""

QUERIES = {
    "endpoint_derive": (
        endpoint_derive,
        f"WITH {X6} SELECT cohort_id, sample_id, {r('time_months')} AS time_months, event FROM ep",
    ),
    "endpoint_report": (endpoint_report, _REPORT),
    "endpoint_cdr": (
        endpoint_cdr,
        f"WITH {_CDR} SELECT sample_id, {r('least(t, 60e0)')} AS time_months, "
        "CASE WHEN t > 60 THEN 0 ELSE e END AS event FROM cdr",
    ),
    "endpoint_cdr_report": (
        endpoint_cdr_report,
        f"WITH {_CDR}, c AS (SELECT t, e, CASE WHEN t > 60 THEN 0 ELSE e END AS ev FROM cdr) "
        "SELECT count(*) AS n_project, count(*) FILTER (ev IS NOT NULL AND t > 0) AS n_usable, "
        "count(*) FILTER (ev = 1 AND t > 0) AS n_events, "
        "count(*) FILTER (e = 1 AND t > 60) AS n_censored_by_cap FROM c",
    ),
    "endpoint_overall": (endpoint_overall, _OVERALL),
    "sample_filters": (sample_filters, _FILTER_REPORT),
    "excluded_samples": (
        excluded_samples,
        _FILTERS
        + """ SELECT cohort_id, sample_id, CAST(CASE WHEN NOT coalesce(p1, false) THEN 1 WHEN NOT coalesce(p2, false) THEN 2
 WHEN NOT coalesce(p3, false) THEN 3 ELSE 4 END AS INT) AS rule_no FROM f WHERE NOT coalesce(p1 AND p2 AND p3 AND p4, false)""",
    ),
    "endpoint_requests": (
        endpoint_requests,
        """WITH q AS (SELECT ['TCGA-PRAD', 'thca', 'LGG', 'BRCA'][c_custkey % 4 + 1] AS project,
  ['OS', 'DSS', 'DFI', 'PFI', 'RFS'][c_custkey % 5 + 1] AS endpoint, c_custkey % 3 = 0 AS allowed FROM customer),
p AS (SELECT project, endpoint, CASE WHEN endpoint = 'RFS' THEN 'unknown_endpoint' WHEN NOT allowed AND
  (upper(replace(project, 'TCGA-', '')), endpoint) IN (('PRAD', 'OS'), ('PRAD', 'DSS'), ('PRAD', 'DFI'), ('THCA', 'OS'), ('THCA', 'DSS'), ('LGG', 'DFI'))
  THEN 'discouraged_endpoint' END AS problem FROM q)
SELECT project, endpoint, problem, count(*) AS n FROM p WHERE problem IS NOT NULL GROUP BY ALL""",
    ),
    "filtered_samples": (
        filtered_samples,
        _FILTERS + " SELECT cohort_id, sample_id FROM f WHERE p1 AND p2 AND p3 AND p4",
    ),
    "analysis_set": (
        analysis_set,
        f"WITH {X6} SELECT cohort_id, sample_id, {r('time_months')} AS time_months, event FROM aset",
    ),
    "align_counts": (align_counts, _ALIGN),
    "inspect_attributes": (inspect_attributes, _INSPECT),
    "adjudicate_events": (adjudicate_events, _ADJUDICATE),
    "adjudication_counts": (adjudication_counts, _COUNTS),
    "adjudication_conflicts": (adjudication_conflicts, _CONFLICTS),
}
