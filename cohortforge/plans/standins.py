"""Relations of the data model derived from the supplied TPC-H-like tables.

The supplied tables hold no gene data, so customers act as samples, brands as
features, market segments as cohorts, orders as clinical history and events as
clinical observations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortforge.functions.staging import literal_rows, written

SIGNATURE_ROWS: list[tuple[str, str, int, float | None, str]] = (
    [("s20", f"Brand#{i}", i, None, "rowmean") for i in range(1, 21)]
    + [("w8", f"Brand#{i}", i, (i % 5 - 2) / 10.0, "weighted") for i in range(1, 9)]
    + [("gap", f"Brand#{i}", i, None, "rowmean") for i in range(1, 5)]
    + [("gap", "Absent#1", 5, None, "rowmean"), ("gap", "Absent#2", 6, None, "rowmean")]
    + [("tiny", f"Brand#{i}", i, None, "rowmean") for i in range(1, 3)]
)
ALIAS_ROWS = [
    ("BRAND#21", "Brand#1"),
    ("BRAND#22", "Brand#2"),
    ("BRAND#22", "Brand#3"),
    ("BRAND#23", "Brand#23"),
]
EXPECTATION_ROWS = [
    ("AUTOMOBILE", 250, 0, 25, 10),
    ("BUILDING", 250, 1000000, 30, 10),
    ("FURNITURE", 250, 1000000, 25, 1000000),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signatures(spark: SparkSession) -> DataFrame:
    return literal_rows(
        spark,
        SIGNATURE_ROWS,
        "signature string, gene string, gene_pos int, coefficient double, scoring string",
    )


def signature_genes(name: str | None = None) -> list[str]:
    return sorted({r[1] for r in SIGNATURE_ROWS if name in (None, r[0])})


def aliases(spark: SparkSession) -> DataFrame:
    pairs = literal_rows(spark, ALIAS_ROWS, "alias string, approved string")
    return pairs.groupBy("alias").agg(F.array_sort(F.collect_set("approved")).alias("approved"))


def expectations(spark: SparkSession) -> DataFrame:
    return literal_rows(
        spark,
        EXPECTATION_ROWS,
        "cohort_id string, n_samples long, n_samples_tolerance long, min_genes long, min_events long",
    )


def revenue_lines(spark: SparkSession, sf_dir: str, genes: list[str] | None = None) -> DataFrame:
    """Line revenue with order, customer and part attributes."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    if genes:
        part = part.filter(F.col("p_brand").isin(genes))
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus"
    )
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey"
    )
    return (
        lines.join(part, lines["l_partkey"] == part["p_partkey"])
        .join(orders, "l_orderkey")
        .join(customers, "o_custkey")
    )


def linear_expression(spark: SparkSession, sf_dir: str, genes: list[str] | None = None) -> DataFrame:
    """X1 before the logarithm: revenue per customer and brand."""
    return (
        revenue_lines(spark, sf_dir, genes)
        .groupBy(
            F.col("c_mktsegment").alias("cohort_id"),
            F.col("p_brand").alias("gene"),
            F.col("o_custkey").cast("string").alias("sample_id"),
        )
        .agg(F.sum("revenue").alias("value"))
    )


def expression(
    spark: SparkSession, sf_dir: str, genes: list[str] | None = None, stored: bool = True
) -> DataFrame:
    """X1: sparse log2 matrix, stored like a cohort matrix since the verbs scan it several times."""
    cells = linear_expression(spark, sf_dir, genes).withColumn("value", F.log2(1 + F.col("value")))
    return written(cells, "matrix") if stored else cells


def dense_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X2: embeddings unnested, one feature per position."""
    return (
        table(spark, sf_dir, "embeddings")
        .select(
            F.lit("emb").alias("cohort_id"),
            F.col("vec_id").cast("string").alias("sample_id"),
            F.posexplode("embedding").alias("pos", "value"),
        )
        .select(
            "cohort_id",
            F.format_string("d%02d", F.col("pos")).alias("gene"),
            F.col("pos").cast("long").alias("feature_pos"),
            "sample_id",
            F.col("value").cast("double").alias("value"),
        )
    )


def probe_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X4: one probe per part, stored like a cohort matrix."""
    cells = (
        revenue_lines(spark, sf_dir)
        .groupBy(
            F.col("c_mktsegment").alias("cohort_id"),
            F.col("l_partkey").cast("string").alias("feature"),
            F.col("l_partkey").alias("feature_pos"),
            F.col("o_custkey").cast("string").alias("sample_id"),
        )
        .agg(F.log2(1 + F.sum("revenue")).alias("value"))
    )
    return written(cells, "probe-matrix")


def probe_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = (
        F.when(F.col("p_size") % 17 == 0, F.lit("---"))
        .when(F.col("p_size") % 10 == 0, F.concat("p_brand", F.lit(" /// Brand#1")))
        .otherwise(F.col("p_brand"))
    )
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("probe"), target.alias("symbol")
    )


def clinical_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X6: free-text clinical attributes per customer, as a map."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal", "c_nationkey"
    )
    per_customer = orders.groupBy("o_custkey").agg(
        F.date_diff(F.max("o_orderdate"), F.min("o_orderdate")).alias("span"),
        F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"),
    )
    span = F.concat(F.col("span").cast("string"), F.lit(" days"))
    attrs = F.map_from_arrays(
        F.array(*[F.lit(k) for k in ("time", "status", "followup", "nation")]),
        F.array(
            F.when(F.col("status") == "F", span),
            F.col("status"),
            F.when(F.col("status") != "F", span),
            F.when(F.col("c_nationkey") % 7 != 0, F.col("c_nationkey").cast("string")),
        ),
    )
    return per_customer.join(customers, "o_custkey").select(
        F.col("c_mktsegment").alias("cohort_id"),
        F.col("o_custkey").cast("string").alias("sample_id"),
        attrs.alias("attrs"),
        "c_acctbal",
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X7: four clinical observations per patient from the event stream."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    flag = (
        F.when(F.col("event_type") == "error", F.lit("YES"))
        .when(F.col("event_type") == "purchase", F.lit("NO"))
    )
    first_day = F.when(
        F.col("event_type") == "error",
        F.when(F.col("value") < 20, F.lit("bad")).otherwise(
            F.format_string("%.2f", F.col("value") * 20)
        ),
    )
    one = lambda c: F.when(c.isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
    return events.select(
        F.floor(F.col("event_id") / 4).cast("string").alias("patient"),
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("record"),
        one(flag).alias("biochemical_recurrence"),
        one(first_day).alias("days_to_first_biochemical_recurrence"),
        one((40 * k - 200).cast("string")).alias("days_to_last_followup"),
    )


def aliquots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X8: one aliquot per order, with a barcode and the order total."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_nationkey"
    )
    patient = F.concat(
        F.lit("TCGA-"),
        F.lpad(F.col("c_nationkey").cast("string"), 2, "0"),
        F.lit("-"),
        F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0"),
    )
    kind = F.when(F.col("o_orderstatus") == "P", F.lit("11")).otherwise(F.lit("01"))
    return orders.join(customers, "o_custkey").select(
        F.concat(
            patient, F.lit("-"), kind, F.lit("A-"),
            F.lpad(F.col("o_orderkey").cast("string"), 12, "0"),
        ).alias("barcode"),
        F.col("o_totalprice").alias("value"),
        "o_orderkey",
    )


def filled_expression(spark: SparkSession, sf_dir: str, genes: list[str]) -> DataFrame:
    """X1 as a complete matrix: a customer without revenue on a brand has value zero."""
    customers = table(spark, sf_dir, "customer").select(
        F.lit("all").alias("cohort_id"), F.col("c_custkey").cast("string").alias("sample_id")
    )
    grid = customers.withColumn("gene", F.explode(F.array(*[F.lit(g) for g in genes])))
    cells = expression(spark, sf_dir, genes, stored=False).select("gene", "sample_id", "value")
    return grid.join(cells, ["gene", "sample_id"], "left").withColumn(
        "value", F.coalesce("value", F.lit(0.0))
    )
