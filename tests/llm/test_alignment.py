"""Alignment of two tokenizers against the libraries, text by text."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest

from tests.llm import samples
from tests.llm.aligned import aligned

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, chunk long, pairs string, n_a string"
AWKWARD = [
    (1, "a▁b x"),
    (2, "x  y\n\nz <|endoftext|> <s> <0x41>\n q"),
    (3, "=" * 3000),
    (4, "日本語 テキスト　x é́ 😀😀"),
    (5, None),
    (6, ""),
    (7, " "),
    (8, "\n"),
    (9, " lead\nx"),
    (None, "tail \n"),
    (10, "\x00\x01 a\tb\x85c\xa0d"),
    (11, "ab" * 5000),
    (1, "a▁b x"),
    (9, " lead\nx"),
    (12, "the words of a very long text " * 4000),
]


def _key(row: tuple):
    return (row[0] is None, row[0] or 0, row[1:])


def _check(spark, docs):
    from cohortforge.llm.alignment import align

    frame = spark.createDataFrame([(d, t, 1, "x", "y") for d, t in docs], SCHEMA).repartition(3)
    got = align(frame, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=_key) == sorted(aligned(docs, A, B), key=_key)


def test_awkward_texts(spark):
    _check(spark, AWKWARD + [(r[0], r[1]) for r in samples.rows()])


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    _check(spark, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_chunks_large_groups_and_forgotten_segments(spark, monkeypatch):
    """Counts don't depend on the bounds of chunks, links and known segments."""
    import pyarrow as pa

    from cohortforge.llm import alignment
    from cohortforge.llm.token_pairs import TokenPair

    texts = [t for _, t in AWKWARD] + [r[1] for r in samples.rows()]
    column = pa.array(texts, pa.large_string())
    pair = TokenPair(A, B)
    first = alignment.Aligned(pair, column)
    monkeypatch.setattr(alignment, "LARGE", 1)
    monkeypatch.setattr(alignment, "LANE", 3)
    again = alignment.Aligned(TokenPair(A, B, most=5), column)
    for name in ("pair_first", "links", "groups"):
        assert np.array_equal(getattr(first, name), getattr(again, name)), name
    for lo, hi in zip(first.pair_first[:-1], first.pair_first[1:]):
        one, other = (dict(zip(x.pairs[lo:hi].tolist(), x.times[lo:hi].tolist())) for x in (first, again))
        assert one == other
    assert first.digests(pair) == again.digests(pair)


def test_empty_table(spark):
    from cohortforge.llm.alignment import align

    assert align(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


def test_lockstep_meets_where_both_end():
    from cohortforge.llm.alignment import lockstep

    # Two lanes: bytes 0-6 and 6-10.
    a_end, b_end = np.array([1, 3, 6, 8, 10]), np.array([2, 3, 6, 7, 9, 10])
    found = [tuple(int(v) for v in row) for step in lockstep(a_end, b_end, np.array([0, 3, 5]), np.array([0, 3, 6])) for row in zip(*step)]
    assert sorted(found) == [(0, 2, 0, 2), (2, 3, 2, 3), (3, 5, 3, 6)]


@pytest.mark.parametrize("seed", range(3))
def test_random_bytes(spark, seed):
    random = np.random.default_rng(seed)
    alphabet = list("ab \n.'1é▁<0x　\t") + ["the", " of", "日", "😀", "<0x0A>", "  "]
    _check(spark, [(i, "".join(random.choice(alphabet, random.integers(0, 60)))) for i in range(60)])
