"""Survival endpoints: derivation, sample filters and the analysis set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortforge.functions import text
from cohortforge.functions.hashing import population_hash
from cohortforge.functions.numeric import ratio, tidy_double
from cohortforge.functions.staging import written

EXAMPLES = 10

# Endpoint columns of the clinical data resource, and the
# endpoints its authors advise against.
CDR_ENDPOINTS = {
    "OS": ("OS", "OS.time"),
    "DSS": ("DSS", "DSS.time"),
    "DFI": ("DFI", "DFI.time"),
    "PFI": ("PFI", "PFI.time"),
}
DISCOURAGED = [
    ("PRAD", "OS"),
    ("PRAD", "DSS"),
    ("PRAD", "DFI"),
    ("THCA", "OS"),
    ("THCA", "DSS"),
    ("LGG", "DFI"),
]

SPEC_SCHEMA = (
    "cohort_id string, time_column string, event_column string, censored_time_column string, "
    "time_unit string, event_values array<string>, censor_values array<string>, cap_months double"
)


def _cap(time: Column, event: Column, cap: Column) -> tuple[Column, Column, Column]:
    """Administrative censoring at a horizon: capped time, event and the beyond flag.

    Anything beyond the horizon is event-free at it, an unknown event included.
    """
    beyond = F.coalesce(time > cap, F.lit(False))
    return F.when(beyond, cap).otherwise(time), F.when(beyond, 0).otherwise(event), beyond


def derive(clinical: DataFrame, specs: DataFrame, by: str = "cohort_id") -> DataFrame:
    """Add time, event and bookkeeping flags to raw clinical rows.

    ``clinical`` carries free text in ``attrs``; ``specs`` has one row per
    cohort (see ``SPEC_SCHEMA``), so differently encoded cohorts share one job.
    Unresolved rows are kept with NULLs.  Follow-up time fills in only where the
    event did not occur and its own time is missing.
    """
    columns = [c for c in clinical.columns]
    joined = clinical.join(specs, by)
    value = lambda name: F.col("attrs")[F.col(name)]
    staged = (
        joined.withColumn("_raw", value("event_column"))
        .withColumn("_e", text.event_indicator(F.col("_raw"), F.col("event_values"), F.col("censor_values")))
        .withColumn("_t0", text.months_from_text(value("time_column"), F.col("time_unit")))
        .withColumn("_t1", text.months_from_text(value("censored_time_column"), F.col("time_unit")))
        .withColumn(
            "from_followup",
            F.coalesce((F.col("_e") == 0) & F.col("_t0").isNull() & F.col("_t1").isNotNull(), F.lit(False)),
        )
        .withColumn("_t", F.when(F.col("from_followup"), F.col("_t1")).otherwise(F.col("_t0")))
    )
    time, event, beyond = _cap(F.col("_t"), F.col("_e"), F.col("cap_months"))
    return staged.select(
        *columns,
        time.alias("time_months"),
        event.cast("int").alias("event"),
        "from_followup",
        (beyond & F.coalesce(F.col("_e") == 1, F.lit(False))).alias("censored_by_cap"),
        (F.col("_e").isNull() & F.col("_raw").isNotNull()).alias("unparsed_event"),
        F.col("_raw").alias("event_text"),
    )


def missing_spec_columns(clinical: DataFrame, specs: DataFrame, by: str = "cohort_id") -> DataFrame:
    """Declared columns a cohort never has: a spec error, listed before any derivation."""
    keys = (
        clinical.select(by, F.explode(F.map_keys("attrs")).alias("column")).distinct()
    )
    declared = specs.select(
        by,
        F.explode(
            F.array_compact(F.array("time_column", "event_column", "censored_time_column"))
        ).alias("column"),
    )
    return declared.join(keys, [by, "column"], "left_anti")


def top_examples(
    values: DataFrame, by: list[str], value: str, limit: int, out: str
) -> DataFrame:
    """First ``limit`` distinct values per group in sorted order, as an array.

    The group limit is applied before the shuffle, so a group with many values
    sends only ``limit`` of them per task.
    """
    order = Window.partitionBy(*by).orderBy(value)
    return (
        values.select(*by, value).distinct()
        .withColumn("_rn", F.row_number().over(order))
        .filter(F.col("_rn") <= limit)
        .groupBy(*by)
        .agg(F.array_sort(F.collect_list(value)).alias(out))
    )


def report(derived: DataFrame, by: str = "cohort_id") -> DataFrame:
    """Counts of what derivation produced and discarded, per cohort."""
    usable = F.col("time_months").isNotNull() & F.col("event").isNotNull()
    counts = derived.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_input"),
        F.count_if(usable).alias("n_usable"),
        F.count_if(usable & (F.col("event") == 1)).alias("n_events"),
        F.count_if(~usable & ~F.col("unparsed_event")).alias("n_dropped_missing"),
        F.count_if("unparsed_event").alias("n_unparsed_event"),
        F.count_if("censored_by_cap").alias("n_censored_by_cap"),
        F.count_if("from_followup").alias("n_time_from_followup"),
    )
    strange = top_examples(
        derived.filter("unparsed_event"), [by], "event_text", EXAMPLES, "unrecognised"
    )
    return (
        counts.withColumn("event_rate", ratio(F.col("n_events"), F.col("n_usable")))
        .join(strange, by, "left")
        .withColumn("unrecognised", F.coalesce("unrecognised", F.array().cast("array<string>")))
    )


def is_analysable(time: str = "time_months", event: str = "event") -> Column:
    return F.col(time).isNotNull() & F.col(event).isin(0, 1) & (F.col(time) > 0)


def analysis_set(derived: DataFrame) -> DataFrame:
    """Samples with a usable endpoint; must precede any standardisation."""
    return derived.filter(is_analysable())


def restrict(matrix: DataFrame, samples: DataFrame, by: str = "cohort_id") -> DataFrame:
    """Keep the matrix cells of the given samples."""
    return matrix.join(samples.select(by, "sample_id"), [by, "sample_id"], "left_semi")


def align_counts(
    matrix_samples: DataFrame, derived: DataFrame, by: str = "cohort_id"
) -> DataFrame:
    """Samples per side, in both, and in the analysis set, with its population hash."""
    left = matrix_samples.select(by, "sample_id").distinct().withColumn("_x", F.lit(1))
    right = derived.select(
        by, "sample_id", F.lit(1).alias("_c"),
        F.coalesce(is_analysable(), F.lit(False)).alias("_a"), "event",
    )
    both = written(left.join(right, [by, "sample_id"], "full_outer"), "aligned")
    aligned = F.col("_x").isNotNull() & F.col("_c").isNotNull()
    kept = aligned & F.col("_a")
    counts = both.groupBy(by).agg(
        F.count("_x").alias("n_expression"),
        F.count("_c").alias("n_clinical"),
        F.count_if(aligned).alias("n_aligned"),
        F.count_if(kept).alias("n_analysis"),
        F.count_if(kept & (F.col("event") == 1)).alias("n_events"),
    )
    hashes = population_hash(both.filter(kept), [by]).drop("n_samples")
    return counts.join(hashes, by, "left")


def misaligned(matrix_samples: DataFrame, clinical: DataFrame, by: str = "cohort_id", limit: int = 5) -> DataFrame:
    """Alignment problems per cohort: one-sided and duplicated sample ids, with examples."""
    left = matrix_samples.groupBy(by, "sample_id").agg(F.count(F.lit(1)).alias("_x"))
    right = clinical.groupBy(by, "sample_id").agg(F.count(F.lit(1)).alias("_c"))
    both = left.join(right, [by, "sample_id"], "full_outer")
    problem = (
        F.when(F.col("_c").isNull(), "expression_only")
        .when(F.col("_x").isNull(), "clinical_only")
        .when(F.col("_x") > 1, "duplicate_expression")
        .when(F.col("_c") > 1, "duplicate_clinical")
    )
    bad = both.withColumn("problem", problem).filter(F.col("problem").isNotNull())
    sizes = bad.groupBy(by, "problem").agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(top_examples(bad, [by, "problem"], "sample_id", limit, "examples"), [by, "problem"])


# Sample filters ---------------------------------------------------------------


def _passes(rule: dict) -> Column:
    """Predicate of one rule; a missing value is the token ``nan``."""
    modes = [m for m in ("keep", "drop", "drop_contains") if rule.get(m)]
    if len(modes) != 1:
        raise ValueError(f"filter on {rule.get('column')!r} must set exactly one of keep, drop, drop_contains")
    value = F.lower(F.trim(F.coalesce(F.col("attrs")[rule["column"]], F.lit("nan"))))
    tokens = [str(v).lower() for v in rule[modes[0]]]
    if modes[0] == "keep":
        return value.isin(tokens)
    if modes[0] == "drop":
        return ~value.isin(tokens)
    hit = F.lit(False)
    for token in tokens:
        hit = hit | F.contains(value, F.lit(token))
    return ~hit


def describe_rule(rule: dict) -> str:
    if rule.get("keep"):
        return f"{rule['column']} in {list(rule['keep'])}"
    if rule.get("drop"):
        return f"{rule['column']} not in {list(rule['drop'])}"
    return f"{rule['column']} does not contain {list(rule['drop_contains'])}"


def apply_filters(clinical: DataFrame, rules: list[dict]) -> DataFrame:
    """Rows that pass every rule, in order."""
    out = clinical
    for rule in rules:
        out = out.filter(_passes(rule))
    return out


def filter_report(clinical: DataFrame, rules: list[dict], by: str = "cohort_id") -> DataFrame:
    """Rows before and after each rule, from one pass over the table."""
    passed = F.lit(True)
    aggs = []
    for i, rule in enumerate(rules):
        aggs.append(F.count_if(passed).alias(f"_b{i}"))
        passed = passed & _passes(rule)
        aggs.append(F.count_if(passed).alias(f"_a{i}"))
    rows = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("rule_no"),
                F.lit(describe_rule(rule)).alias("rule"),
                F.col(f"_b{i}").alias("n_before"),
                F.col(f"_a{i}").alias("n_after"),
                (F.col(f"_b{i}") - F.col(f"_a{i}")).alias("n_dropped"),
            )
            for i, rule in enumerate(rules)
        ]
    )
    return clinical.groupBy(by).agg(*aggs).select(by, F.inline(rows))


def excluded_samples(clinical: DataFrame, rules: list[dict], by: str = "cohort_id") -> DataFrame:
    """(cohort, sample_id, rule_no, reason) of every row a rule removes: the first one that does."""
    no, why = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i in reversed(range(len(rules))):
        fails = ~F.coalesce(_passes(rules[i]), F.lit(False))
        no = F.when(fails, i + 1).otherwise(no)
        why = F.when(fails, describe_rule(rules[i])).otherwise(why)
    marked = clinical.withColumn("rule_no", no).withColumn("reason", why)
    return marked.filter(F.col("rule_no").isNotNull()).select(by, "sample_id", "rule_no", "reason")


def filter_problems(clinical: DataFrame, rules: list[dict], by: str = "cohort_id") -> DataFrame:
    """Rules that name a column a cohort lacks, or that remove its last sample."""
    named = clinical.groupBy(by).agg(
        *[
            F.bool_or(F.map_contains_key("attrs", rule["column"])).alias(f"_c{i}")
            for i, rule in enumerate(rules)
        ]
    )
    unknown = named.select(
        by,
        F.inline(
            F.array_compact(
                F.array(
                    *[
                        F.when(
                            ~F.col(f"_c{i}"),
                            F.struct(F.lit(i + 1).alias("rule_no"), F.lit("unknown_column").alias("problem")),
                        )
                        for i in range(len(rules))
                    ]
                )
            )
        ),
    )
    emptied = filter_report(clinical, rules, by).filter(
        (F.col("n_before") > 0) & (F.col("n_after") == 0)
    ).select(by, "rule_no", F.lit("removed_every_sample").alias("problem"))
    return unknown.unionByName(emptied)


# Published endpoint tables ------------------------------------------------------


def check_cdr_endpoint(project: str, endpoint: str, allow_discouraged: bool = False) -> None:
    if endpoint not in CDR_ENDPOINTS:
        raise ValueError(f"unknown endpoint {endpoint!r}, choose from {sorted(CDR_ENDPOINTS)}")
    short = project.replace("TCGA-", "").upper()
    if not allow_discouraged and (short, endpoint) in DISCOURAGED:
        raise ValueError(f"{endpoint} is advised against for {project}; override it deliberately")


def endpoint_problems(requests: DataFrame) -> DataFrame:
    """Requests (project, endpoint, allow_discouraged) that must be refused, with the problem.

    The same rule as ``check_cdr_endpoint``, as a predicate over rows.
    """
    short = F.upper(F.replace(F.col("project"), F.lit("TCGA-"), F.lit("")))
    advised = F.lit(False)
    for project, endpoint in DISCOURAGED:
        advised = advised | ((short == project) & (F.col("endpoint") == endpoint))
    problem = F.when(~F.col("endpoint").isin(*CDR_ENDPOINTS), "unknown_endpoint").when(
        advised & ~F.coalesce("allow_discouraged", F.lit(False)), "discouraged_endpoint"
    )
    return requests.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def first_per_key(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """First row per key by an ordinal, as an aggregate rather than a window."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(ordinal)).alias("_first"))
    return picked.select(*keys, "_first.*")


def cdr_endpoint(
    cdr: DataFrame,
    project: str,
    endpoint: str = "PFI",
    cap_months: float | None = 60.0,
    allow_discouraged: bool = False,
    ordinal: str = "line_no",
) -> DataFrame:
    """Patient endpoint from a clinical data resource table (times in days)."""
    check_cdr_endpoint(project, endpoint, allow_discouraged)
    event_column, time_column = CDR_ENDPOINTS[endpoint]
    for column in (event_column, time_column, "bcr_patient_barcode"):
        if column not in cdr.columns:
            raise ValueError(f"endpoint table has no {column!r} column")
    rows = cdr
    if "type" in cdr.columns:
        rows = rows.filter(F.upper("type") == project.replace("TCGA-", "").upper())
    numeric = rows.select(
        F.col("bcr_patient_barcode").cast("string").alias("sample_id"),
        F.col(ordinal),
        (tidy_double(F.col(f"`{time_column}`")) / text.DAYS_PER_MONTH).alias("_t"),
        tidy_double(F.col(f"`{event_column}`")).cast("int").alias("_e"),
    )
    first = first_per_key(numeric, ["sample_id"], ordinal)
    time, event, beyond = _cap(F.col("_t"), F.col("_e"), F.lit(cap_months).cast("double"))
    return first.select(
        "sample_id",
        time.alias("time_months"),
        event.cast("int").alias("event"),
        (beyond & F.coalesce(F.col("_e") == 1, F.lit(False))).alias("censored_by_cap"),
    )


def cdr_report(endpoint: DataFrame) -> DataFrame:
    """Counts of a published endpoint; usable also needs a positive time here."""
    usable = is_analysable()
    return endpoint.agg(
        F.count(F.lit(1)).alias("n_project"),
        F.count_if(usable).alias("n_usable"),
        F.count_if(usable & (F.col("event") == 1)).alias("n_events"),
        F.count_if("censored_by_cap").alias("n_censored_by_cap"),
    )


def overall_survival(clinical: DataFrame) -> DataFrame:
    """Overall survival from vital status and day fields."""
    dead = F.coalesce(F.lower("vital_status") == "dead", F.lit(False))
    days = F.when(dead, tidy_double(F.col("days_to_death"))).otherwise(
        tidy_double(F.col("days_to_last_follow_up"))
    )
    return clinical.withColumn("event", dead.cast("int")).withColumn(
        "time_months", days / text.DAYS_PER_MONTH
    )


def inspect_attributes(clinical: DataFrame, by: str = "cohort_id", limit: int = 3) -> DataFrame:
    """Clinical columns of each cohort with a few example values."""
    pairs = clinical.select(by, F.explode("attrs").alias("column", "value"))
    present = pairs.filter(F.col("value").isNotNull())
    counts = pairs.groupBy(by, "column").agg(F.count("value").alias("n_present"))
    return counts.join(
        top_examples(present, [by, "column"], "value", limit, "examples"), [by, "column"], "left"
    )
