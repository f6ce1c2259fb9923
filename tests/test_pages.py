"""Landed pages that are read back as whole files."""

from __future__ import annotations

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_manifest_pages_are_all_read(spark, monkeypatch):
    from cohortforge.catalogue import source_queries

    monkeypatch.setattr(source_queries, "PAGE_ROWS", 50, raising=False)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        got = source_queries.manifest_scan(spark, SF).agg(F.sum("n_files"), F.sum("n_bytes")).first()
    finally:
        spark.conf.set(name, before)
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    assert tuple(got) == tuple(orders.agg(F.count("*"), F.sum("o_orderkey")).first())
