"""Registered queries against their SQL, and the pipeline against plain Python."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohortforge.llm.queries import QUERIES
from tests.llm import samples

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query_equals_its_sql(spark, name):
    from tests.oracle_check import compare, connect

    query, sql = QUERIES[name]
    assert compare(query(spark, SF), connect(SF), sql) == []


def test_near_duplicates_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = samples.near_components([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: r.component_id for r in QUERIES["op7_near_duplicates"][0](spark, SF).collect()}
    assert got == want


def test_every_stage(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{number}")
        out = spark.read.parquet(f"{tmp_path}/{number}")
        if name != "packing":
            assert out.columns == docs.columns
            after = {r.doc_id: r.text for r in out.collect()}
            kept.append(len(after))
        if name == "language_id":
            letters = [d for d, t in before if any(c.isalpha() for c in t or "")]
            assert set(after) <= set(letters) and len(after) >= 0.99 * len(letters)
        elif name == "line_dedup":
            lines = samples.line_kept([(d, t) for d, t in before if t is not None])
            want = {d: "\n".join(x) for d, x in lines.items() if samples.words("\n".join(x)) or "\n".join(x) == dict(before)[d]}
            assert after == want
            assert out.where(F.col("n_chars") != F.length("text")).count() == 0
        elif name == "near_dedup":
            components = samples.near_components(before, 80)
            assert set(after) == {d for d, c in components.items() if d == c}
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            leaked = {d for d, _ in samples.leaks(before, items)}
            assert leaked and set(after) == {d for d, _ in before} - leaked
        else:
            rows = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
            assert {r.doc_id for r in rows} == {d for d, _ in before} and all(r.n == r.m for r in rows)
        docs = out
    assert kept == sorted(kept, reverse=True)
