"""Jaccard components against comparing all pairs that share a shingle."""

from __future__ import annotations

import numpy as np

from tests.llm import samples


def _rows(spark, docs):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, rep string, n long")


def _found(spark, docs, percent=80):
    from cohortforge.llm.jaccard_join import jaccard_components

    out = jaccard_components(_rows(spark, docs), percent=percent)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    return out.collect()


def test_awkward_texts(spark):
    docs = [(r[0], r[1]) for r in samples.rows()]
    got = _found(spark, docs)
    assert len(got) == len(docs)
    named = [(d, t) for d, t in docs if d is not None]
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == samples.near_components(named, 80)
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert {r.doc_id: r.n_shingles for r in got if r.doc_id is not None} == {d: len(samples.shingles(t)) for d, t in named}


def test_at_the_threshold(spark):
    """Pairs of exactly 80 percent, just below and above it, of all sizes."""
    docs, random = [], np.random.default_rng(5)
    for size in [5, 6, 9, 14, 24, 29, 54, 104, 204]:
        for share in (0.78, 0.799, 0.8, 0.801, 0.85):
            base = [f"s{size}p{share}w{i}" for i in range(size)]
            docs.append((len(docs), " ".join(base)))
            keep = int(np.ceil(share * (size - 4))) + 4
            docs.append((len(docs), " ".join(base[:keep])))
    for n in range(150):
        base = [f"n{n}w{i}" for i in range(int(random.integers(20, 200)))]
        docs.append((len(docs), " ".join(base)))
        changed = list(base)
        for place in random.choice(len(base), min(len(base), 1 + n % 4), replace=False):
            changed[place] = f"c{n}p{place}"
        docs.append((len(docs), " ".join(changed)))
    for percent in (80, 85):
        assert {r.doc_id: r.component_id for r in _found(spark, docs, percent)} == samples.near_components(docs, percent)


def test_large_cells_are_cut_without_loss(spark, monkeypatch):
    from cohortforge.llm import blocks

    monkeypatch.setattr(blocks, "ROWS", 6)
    monkeypatch.setattr(blocks, "BRIDGES", 1)
    template, docs = [f"t{i}" for i in range(100)], []
    # Members of one template at about 0.75, some with a near copy, and a chain of near copies.
    for n in range(80):
        docs.append((len(docs), " ".join(template + [f"d{n}w{i}" for i in range(16)])))
        if n % 8 == 0:
            docs.append((len(docs), samples.near(docs[-1][1], [110])))
    for n in range(40):
        docs.append((len(docs), " ".join(f"chain{i}" for i in range(n * 5, n * 5 + 100))))
    want = samples.near_components(docs, 80)
    assert 80 < len(set(want.values())) < len(docs)
    assert {r.doc_id: r.component_id for r in _found(spark, docs)} == want


def test_repeated_ids_are_one_document(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    docs = [(5, a), (5, b), (3, a), (7, samples.near(b, [30])), (7, samples.near(b, [30])), (9, "other words here")]
    got = {(r.doc_id, r.component_id) for r in _found(spark, docs)}
    assert got == {(5, 3), (3, 3), (7, 3), (9, 9)}


def test_empty_table(spark):
    assert _found(spark, []) == []


def test_query_on_documents(spark):
    from cohortforge.llm.queries import op13_jaccard_join

    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.component_id for r in op13_jaccard_join(spark, folder).collect()}
    assert got == samples.near_components(docs, 80)
