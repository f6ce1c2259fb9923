"""Near duplicates against brute force, at thresholds and sizes where candidates are easily lost."""

from __future__ import annotations

import numpy as np

from tests.llm import samples


def _similarity(a: str, b: str) -> float:
    a, b = samples.shingles(a), samples.shingles(b)
    return len(a & b) / len(a | b)


def _unlike(number: int, size: int) -> list[str]:
    return [f"d{number}w{i}" for i in range(size)]


def test_stage_links_at_80_percent(spark):
    from cohortforge.llm.near_dup import near_duplicates
    from cohortforge.llm.stages import dedup_near

    texts = []
    for n in range(40):
        base = _unlike(n, 204)
        # 162 to 168 of 200 shingles: a prefix, so that the sizes differ as much as the sets.
        texts += [" ".join(base), " ".join(base[: 164 + n % 10])]
    for n in range(40, 80):
        base = _unlike(n, 204)
        texts += [" ".join(base), samples.near(" ".join(base), [10, 60, 120, 180][: 2 + n % 3])]
    found = [_similarity(a, b) for a, b in zip(texts[::2], texts[1::2], strict=True)]
    assert sum(0.80 <= x < 0.85 for x in found) >= 30 and min(found) == 0.80
    docs = [(i, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for percent in (80, 85):
        got = {r.doc_id: r.component_id for r in near_duplicates(frame, percent=percent).collect()}
        assert got == samples.near_components(docs, percent)
    kept = {r.doc_id for r in dedup_near(spark, frame, "").collect()}
    assert kept == {d for d, c in samples.near_components(docs, 80).items() if d == c}


def test_pairs_in_a_large_node_of_the_last_level(spark, monkeypatch):
    from cohortforge.llm import near_dup

    monkeypatch.setattr(near_dup, "SMALL", 12)
    monkeypatch.setattr(near_dup, "BRIDGES", 2)
    monkeypatch.setattr(near_dup, "DEPTH", 1)
    # A family of one template: members share 0.45 or so, and a tenth has a near copy.
    template, docs = [f"t{i}" for i in range(120)], []
    for n in range(240):
        docs.append((len(docs), " ".join(template + _unlike(n, 75))))
        if n % 10 == 0:
            docs.append((len(docs), samples.near(docs[-1][1], [130, 170])))
    assert 0.4 < _similarity(docs[2][1], docs[3][1]) < 0.53 and 0.85 <= _similarity(docs[0][1], docs[1][1]) < 0.97
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(frame).collect()}
    assert got == samples.near_components(docs)
