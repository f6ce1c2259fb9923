"""Periodic runs against trying every period at every place."""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tests.llm import samples


def brute_runs(w: list, least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """``start, length, period`` by start, then period."""
    out, n = [], len(w)
    for q in range(1, n // exponent + 1):
        at = 0
        while at + q < n:
            end = at
            while end + q < n and w[end] == w[end + q]:
                end += 1
            size = end + q - at
            if end > at and size >= max(least, exponent * q):
                smaller = any(all(w[at + k] == w[at + k + r] for k in range(size - r)) for r in range(1, q))
                if not smaller:
                    out.append((at, size, q))
            at = end + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def rewritten(doc_id: int | None, w: list) -> list:
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(w)
    if h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return w[:a] + [w[a + (i - a) % p] for i in range(a, n)]


def expected(doc_id: int | None, text: str | None, rewrite: bool) -> tuple:
    w = samples.words(text)
    if rewrite:
        w = rewritten(doc_id, w)
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)]
    return doc_id, len(runs), *best, milli, *sha, runs, kept


def _key(row: tuple):
    return (row[0] is None, row[0] or 0, str(row))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"]


def _check(spark, docs: list[tuple], rewrite: bool):
    from cohortforge.llm.periodic_runs import made_periodic, periodic_runs

    # Extra columns, among them ones named like added and internal ones.
    frame = spark.createDataFrame([(d, t, "s", 5, "x", "y") for d, t in docs], "doc_id long, text string, start string, period long, _run_id string, _run_text string")
    out = periodic_runs(frame.repartition(3), rewrite=made_periodic if rewrite else None)
    assert {"_run_id", "_run_text"} < set(out.columns) and "text" not in out.columns
    assert {tuple(r) for r in out.select("_run_id", "_run_text").collect()} <= {("x", "y")}
    rows = [(*r[:8], [(x.start, x.length, x.period) for x in r[8]], r[9]) for r in out.select(*COLUMNS).collect()]
    assert sorted(rows, key=_key) == sorted((expected(d, t, rewrite) for d, t in docs), key=_key)


def test_awkward_texts(spark):
    texts = [
        "a b " * 9,
        "a a a a a",
        "a a a a a a",
        "x " + "a b c " * 5 + "a b d",
        "a a a a a a b " * 6,
        "a\x1cb a\x85b é é é é é é é",
        "be " * 400 + "end",
        " ".join(f"{i % 7}" for i in range(900)),
        "A a A a A a A a",
    ]
    docs = [(r[0], r[1]) for r in samples.rows()] + [(100 + i, t) for i, t in enumerate(texts)] + [(100, texts[0]), (None, texts[0])]
    docs += [(1000 + i, " ".join(f"w{i}x{k}" for k in range(i))) for i in range(40)]
    _check(spark, docs, rewrite=False)
    _check(spark, docs, rewrite=True)


def test_query_on_documents(spark):
    from cohortforge.llm.queries import op12_periodic_runs

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    short = {r.doc_id: r.text for r in docs if len(samples.words(r.text)) < 700}
    got = {r.doc_id: tuple(r[c] for c in COLUMNS[:8]) for r in op12_periodic_runs(spark, folder).collect()}
    assert len(got) == len(docs)
    assert {d: got[d] for d in short} == {d: expected(d, t, True)[:8] for d, t in short.items()}


def test_empty_table(spark):
    from cohortforge.llm.periodic_runs import periodic_runs

    assert periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_random_sequences(seed):
    from cohortforge.llm.periodic_runs import find_runs

    random = np.random.default_rng(seed)
    for _ in range(150):
        docs = []
        for _ in range(random.integers(1, 4)):
            w = random.integers(0, random.integers(1, 4), random.integers(0, 60)).tolist()
            if w and random.random() < 0.6:
                a, p = int(random.integers(len(w))), int(random.integers(1, 7))
                w = w[:a] + [w[a + (i - a) % min(p, len(w) - a)] for i in range(a, len(w))]
            docs.append(w)
        first = np.cumsum([0, *map(len, docs)])
        got = [tuple(r) for r in find_runs(np.array(sum(docs, []), np.int64), first).tolist()]
        assert got == [(int(first[n]) + s, size, q) for n, w in enumerate(docs) for s, size, q in brute_runs(w)]


def test_suffixes_are_in_order():
    from cohortforge.llm.periodic_runs import suffix_array

    word = np.array([1, 2] * 8 + [3, 1, 2, 1, 2, 1, 2, 1, 2])
    order, lcp = suffix_array(word, np.zeros(len(word), int), np.full(len(word), len(word)), 5)
    text = word.tolist()
    for at in range(1, len(order)):
        x, y = text[order[at - 1] :], text[order[at] :]
        common = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
        assert lcp[at] == (common if common >= 5 else 0)


def test_two_periods_are_refused():
    from cohortforge.llm.periodic_runs import find_runs

    with pytest.raises(ValueError):
        find_runs(np.zeros(4, np.int64), np.array([0, 4]), exponent=2)
