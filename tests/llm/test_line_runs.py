"""Maximal repeated line runs against trying every pair of places."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cohortforge.llm.line_dedup import longest_earlier, repeated_runs, suffix_levels
from tests.llm import samples


def longest(docs: list[tuple[int, str]]) -> dict[tuple[int, int], int]:
    """Length of the longest run from each place that also begins at an earlier one."""
    lines = {d: t.split("\n") for d, t in docs}
    places = sorted((d, i) for d, text in lines.items() for i in range(len(text)))
    out = {}
    for at, (d, i) in enumerate(places):
        best = 0
        for e, j in places[:at]:
            n = 0
            while i + n < len(lines[d]) and j + n < len(lines[e]) and lines[d][i + n] == lines[e][j + n]:
                n += 1
            best = max(best, n)
        out[d, i] = best
    return out


def maximal(found: dict[tuple[int, int], int], least: int) -> set[tuple[int, int, int]]:
    return {(d, i, n) for (d, i), n in found.items() if n >= least and found.get((d, i - 1), 0) < n + 1}


def made(seed: int) -> list[tuple[int, str]]:
    """Documents of few different lines, with copied stretches and repeats of their own."""
    rng = random.Random(seed)
    docs: list[list[str]] = []
    for _ in range(14):
        text = [rng.choice("ab") if seed % 2 else f"l{rng.randrange(9)}" for _ in range(rng.randrange(1, 14))]
        if docs and rng.random() < 0.7:
            other = rng.choice(docs)
            a = rng.randrange(len(other))
            text[rng.randrange(len(text) + 1) : 0] = other[a : a + rng.randrange(1, 30)]
        docs.append(text)
    docs.append(["same"] * 37)
    docs.append(list(docs[3]))
    return [(i, "\n".join(t)) for i, t in enumerate(docs)]


def keyed(spark, docs):
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    return rows.select("doc_id", F.xxhash64("text").alias("text_key"), "text")


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_equal_brute_force(spark, seed):
    docs = made(seed)
    want = longest(docs)
    # A repeated row is no copy of itself.
    levels = suffix_levels(keyed(spark, docs + docs[3:5]))
    lines = dict(docs)
    for least in (1, 3):
        found = longest_earlier(levels, least).collect()
        assert {(r.doc_id, r.line): r.length for r in found} == {p: n for p, n in want.items() if n >= least}
        for r in found:
            own = lines[r.doc_id].split("\n")[r.line : r.line + r.length]
            assert lines[r.source.doc_id].split("\n")[r.source.line : r.source.line + r.length] == own
            assert (r.source.doc_id, r.source.line) < (r.doc_id, r.line)
    # Rounds go on until no suffix is repeated: the longest run has 36 lines.
    assert len(levels) == 6 and max(want.values()) == 36
    runs = repeated_runs(keyed(spark, docs), 3).collect()
    assert {(r.doc_id, r.line, r.length) for r in runs} == maximal(want, 3)


def test_runs_of_awkward_documents(spark):
    docs = [(d, t) for d, t, *_ in samples.rows()[:20] if t is not None]
    got = {(r.doc_id, r.line, r.length) for r in repeated_runs(keyed(spark, docs)).collect()}
    assert got == maximal(longest(docs), 2)
    assert repeated_runs(keyed(spark, docs).limit(0)).count() == 0
    assert repeated_runs(keyed(spark, [(1, "alone"), (2, "")])).count() == 0
