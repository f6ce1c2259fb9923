"""Language and quality models, and top-k search."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_is_right_on_held_out_documents(spark, documents):
    from cohortforge.llm.queries import op10_language

    got = op10_language(spark, SF)
    assert got.count() == documents.count()
    truth = documents.select(F.col("doc_id").alias("d"), "lang").where("lang is not null")
    both = got.join(truth, got.doc_id == truth.d).where("held_out").toPandas()
    assert (both.lang_pred == both.lang).mean() > 0.98 and both.score.between(0, 1).all()


def test_language_edge_cases(spark, documents):
    from cohortforge.llm.language import fit, predict

    model = fit(documents, F.lit(True))
    rows = [(1, None, 1), (2, "", 2), (3, "123 !?", 3), (4, "a", 4), (None, "the and of with the", 5)]
    out = {r.k: r for r in predict(spark.createDataFrame(rows, "doc_id long, text string, score int").withColumn("k", F.col("score")), model).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and not any(out[i].accepted for i in (1, 2, 3))
    assert out[4].lang_pred in model.labels and out[5].lang_pred == "en" and 0 <= out[5].score <= 1
    unlabelled = fit(documents.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {r.lang_pred for r in predict(documents.limit(5), unlabelled).collect()} == {"und"}
    assert predict(documents.limit(0), model).count() == 0
    clean = predict(documents, model)
    assert clean.where("accepted").count() >= 0.99 * clean.where("lang_pred <> 'und'").count()


def test_the_language_sample_is_bounded(spark, documents):
    from cohortforge.llm.language import fit

    many = documents.crossJoin(spark.range(3).select(F.col("id").alias("copy")))
    model = fit(many, F.lit(True), sample_rows=40, epochs=1)
    assert model.labels == ["de", "en", "es", "fr"]


def test_quality_is_right_on_held_out_documents(spark, documents):
    from cohortforge.llm.queries import op6_quality

    got, labels = op6_quality(spark, SF), spark.read.parquet(f"{SF}/labels.parquet")
    assert got.count() == documents.count()
    both = got.join(labels, "doc_id").where("held_out").toPandas()
    assert (both.predicted == both.quality).mean() > 0.95
    assert ((both.score >= 0.5) == (both.predicted == 1)).all() and both.score.between(0, 1).all()


def test_quality_edge_cases(spark, documents):
    from cohortforge.llm.quality import fit, score

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = fit(documents, labels.unionAll(labels.limit(3)).withColumn("text", F.lit("clash")))
    rows = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (2, "")], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in score(rows, model).collect())
    assert fit(documents, labels.where("quality = 1")) is None and fit(documents, labels.limit(0)) is None
    assert {r.score for r in score(rows, None).collect()} == {0.5}
    assert score(documents.limit(0), model).count() == 0


def brute(vectors: dict[int, np.ndarray], queries: list[int], k: int) -> list[tuple]:
    out = []
    for q in queries:
        best = sorted(((-int(v @ vectors[q]), i) for i, v in vectors.items() if i != q))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 40])
def test_top_k(spark, block):
    from cohortforge.llm.top_k import top_k

    rng = np.random.default_rng(5)
    near = np.repeat(rng.integers(-200, 200, (20, 12)), 15, axis=0) + rng.integers(-3, 4, (300, 12))
    same = np.repeat(rng.integers(-20, 20, (1, 12)), 120, axis=0)
    vectors = dict(enumerate(np.concatenate([near, same]).astype(np.int64)))
    rows = [(i, v.tolist(), "x") for i, v in vectors.items()] + [(5, vectors[5].tolist(), "again"), (None, [1] * 12, "x"), (999, None, "x"), (998, [None] * 12, "x")]
    table = spark.createDataFrame(rows, "vec_id long, vector array<bigint>, rank string")
    got = top_k(table, F.col("vec_id") % 7 == 0, block_rows=block, chunk_rows=25, pivots=8).collect()
    assert sorted(map(tuple, got)) == brute(vectors, [i for i in vectors if i % 7 == 0], 5)


def test_top_k_of_few_and_none(spark):
    from cohortforge.llm.top_k import top_k

    schema = "vec_id long, vector array<bigint>"
    few = spark.createDataFrame([(0, [1, 2]), (1, [1 << 30, -(1 << 30)]), (2, [0, 0])], schema)
    got = sorted(map(tuple, top_k(few, F.col("vec_id") == 0).collect()))
    assert got == [(0, 1, 2, 0), (0, 2, 1, -(1 << 30))]
    assert top_k(few.limit(0), F.lit(True)).count() == 0
    with pytest.raises(ValueError):
        top_k(few.unionAll(spark.createDataFrame([(4, [1])], schema)), F.lit(True))


def test_search_prunes(spark):
    from cohortforge.llm.top_k import Search

    rng = np.random.default_rng(6)
    centres = rng.normal(0, 300, (40, 16))
    points = np.round(np.repeat(centres, 50, axis=0) + rng.normal(0, 2, (2000, 16))).astype(np.int64)
    search = Search(5, np.arange(100), points[:100], np.full(100, np.iinfo(np.int64).min))
    search.visit(np.arange(2000), points)
    assert search.compared < 0.6 * 100 * 2000
    assert [(int(q), int(i)) for q, row in zip(range(100), search.best, strict=True) for i in row] == [
        (q, i) for q, _, i, _ in brute(dict(enumerate(points)), list(range(100)), 5)
    ]
