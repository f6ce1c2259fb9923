"""Extra columns with the names that operators use inside, and stages on awkward tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohortforge.llm import language, line_dedup, quality, stages, substring_dedup
from cohortforge.llm.features import id_remainder
from tests.llm import samples

SF = "/root/testdata/sf0.001"
NAMES = """_0 _1 _id _key _lines _gone _gone_id _gone_key line name rep starts _starts _repeats _text _letters _lang _score
_k1 _k2 text_key copy_key n lo hi a b node component _node _dropped _leak _often count kept shift item_id item_text
accepted words content first token cell _label _chosen""".split()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(samples.rows(), samples.SCHEMA)


def clashing(docs):
    return docs.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in NAMES])


def content(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("name", ["lines", "substrings", "language", "quality", "quality without a model"])
def test_operators_with_clashing_columns(spark, docs, name):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = {
        "language": lambda: language.fit(given, id_remainder(F.col("doc_id"), 4) != 2, sample_rows=200, epochs=2),
        "quality": lambda: quality.fit(given, labels, sample_rows=200, pairs=500, epochs=1),
    }.get(name, lambda: None)()
    run = {
        "lines": line_dedup.dedup_lines,
        "substrings": substring_dedup.dedup_substrings,
        "language": lambda d: language.predict(d, model),
        "quality": lambda d: quality.score(d, model),
        "quality without a model": lambda d: quality.score(d, None),
    }[name]
    plain, out = run(docs), run(clashing(docs))
    assert content(out, plain.columns) == content(plain, plain.columns)
    added = set(plain.columns) - set(docs.columns)
    for column in set(NAMES) - added:
        assert out.where(F.col("doc_id").isNotNull() & ~F.col(column).eqNullSafe(F.concat(F.lit(f"{column}:"), F.col("doc_id").cast("string")))).count() == 0


STAGES = [stages.keep_languages, stages.dedup_lines, stages.dedup_near, stages.drop_leaks]


@pytest.mark.parametrize("stage", STAGES, ids=lambda s: s.__name__)
def test_stages_on_awkward_tables(spark, docs, stage):
    plain, out = stage(spark, docs, SF), stage(spark, clashing(docs), SF)
    assert plain.columns == docs.columns
    assert out.columns == [*docs.columns, *NAMES]
    assert content(out, docs.columns) == content(plain, docs.columns)
    none = stage(spark, docs.limit(0), SF)
    assert none.columns == docs.columns and none.count() == 0


def test_unlabelled_corpus_keeps_what_has_letters(spark, docs):
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    got = stages.keep_languages(spark, bare, SF)
    want = [r for r in samples.rows() if any(c.isalpha() for c in r[1] or "")]
    assert sorted((r.doc_id is None, r.doc_id) for r in got.collect() if r.doc_id is not None) == sorted((False, r[0]) for r in want if r[0] is not None)
    assert got.count() == len(want)


def test_near_stage_keeps_one_row_of_a_document(spark):
    rows = [(1, samples.BASE), (1, samples.BASE), (2, samples.near(samples.BASE, [3])), (3, "some other text"), (3, "another text"),
            (4, None), (4, None), (None, "no id"), (None, "no id"), (None, "still no id"), (5, "the only one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = content(stages.dedup_near(spark, docs, SF), ["doc_id", "text"])
    want = {(1, samples.BASE), (3, "some other text"), (3, "another text"), (4, None), (None, "no id"), (None, "still no id"), (5, "the only one")}
    assert got == sorted(want, key=repr)


def test_near_stage_links_from_a_similarity_of_80_percent(spark):
    """Pairs between 0.80 and 0.85 are linked, those under 0.80 are not."""
    base = " ".join(f"k{i}" for i in range(204))  # 200 shingles; a changed word far from the ends alters 5
    near_pair = samples.near(base, [20, 60, 100, 140])  # 180 shared of 220: 0.818
    far_pair = samples.near(base.replace("k", "m"), [20, 60, 100, 140, 180])  # 175 of 225: 0.778
    docs = spark.createDataFrame([(1, base), (2, near_pair), (3, base.replace("k", "m")), (4, far_pair)], "doc_id long, text string")
    assert sorted(r.doc_id for r in stages.dedup_near(spark, docs, SF).collect()) == [1, 3, 4]


def test_packing_stage_on_awkward_tables(spark, docs):
    out = stages.pack_sequences(spark, clashing(docs), SF)
    lengths = {(r.doc_id, r.n) for r in out.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    again = {(r.doc_id, r.n) for r in stages.pack_sequences(spark, docs, SF).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert lengths == again
    assert stages.pack_sequences(spark, docs.limit(0), SF).count() == 0
