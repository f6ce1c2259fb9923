"""Operators on documents against plain Python, over awkward small tables."""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import samples

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(samples.rows(), samples.SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], samples.SCHEMA)


@lru_cache
def library(name: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def library_ids(name: str, text: str | None) -> list[int]:
    return library(name).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_segments_equal_the_library(name):
    from cohortforge.llm.segments import SegmentEncoder

    rng = np.random.default_rng(1)
    alphabet = list("ab.,'’ \n\t\r!1é́ÅİΣς中\x1c\x85\xa0 _") + ["<|endoftext|>", "'s", "  ", " \n"]
    texts = ["".join(rng.choice(alphabet, size=n)) for n in rng.integers(0, 60, 400)] + [t for _, t, *_ in samples.rows() if t]
    encode = SegmentEncoder(public_tokenizers.path(name), bits=6)
    for at in range(0, len(texts), 37):
        part = texts[at : at + 37]
        for text, ids in zip(part, encode(part), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library_ids(name, text), repr(text)


def test_token_counts_fill_and_use_the_cache(spark, docs, empty, tmp_path):
    from cohortforge.llm.token_counts import CACHE_SCHEMA, count_tokens

    path, cache = public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/cache"
    for _ in range(2):
        got = [tuple(r) for r in count_tokens(docs, path, cache).collect()]
        want = [(d, len((t or "").encode()), len(library_ids("byte_bpe_50k.json", t))) for d, t, *_ in samples.rows()]
        assert sorted(got, key=str) == sorted(want, key=str)
        stored = spark.read.schema(CACHE_SCHEMA).parquet(cache)
        assert stored.count() == len({t or "" for _, t, *_ in samples.rows()})
    # A stored count is used, not counted anew; another tokenizer has counts of its own.
    planted = spark.read.parquet(cache).withColumn("n_tokens", F.lit(77).cast("long"))
    planted.write.parquet(f"{cache}2")
    assert {r.n_tokens for r in count_tokens(docs, path, f"{cache}2").collect()} == {77}
    other = count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), f"{cache}2").where("doc_id = 9").collect()
    assert other[0].n_tokens == 2
    assert count_tokens(empty, path).count() == 0


def test_packing_keeps_every_id_once(docs, empty):
    from cohortforge.llm.packing import pack

    path = public_tokenizers.path("byte_bpe_50k.json")
    for parts in (1, 7):
        pieces = pack(docs.repartition(parts), path, capacity=256).collect()
        want = sorted((library_ids("byte_bpe_50k.json", t) + [1] for _, t, *_ in samples.rows()), key=str)
        by_doc: dict = {}
        for p in pieces:
            assert len(p.ids) == 4 * p.length > 0
            by_doc.setdefault(p.doc_id, []).append(p)
        got = []
        for group in by_doc.values():
            group.sort(key=lambda p: (p.start, p.sequence_id))
            ids = np.frombuffer(b"".join(p.ids for p in group), "<u4").tolist()
            copies = max(1, round(len(ids) / group[0].doc_tokens))
            assert len(ids) == copies * group[0].doc_tokens
            if copies == 1:
                got.append(ids)
        assert all(ids in want for ids in got) and len(got) >= len(want) - 2
        fill: dict = {}
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == fill.get(p.sequence_id, 0)
            fill[p.sequence_id] = p.offset + p.length
        assert max(fill.values()) <= 256 and sum(v < 256 for v in fill.values()) <= parts
    assert pack(empty, path).count() == 0


def test_level_rule_is_the_least_sum_of_squares():
    from cohortforge.llm.packing import LevelPacker

    rng = np.random.default_rng(2)
    packer = LevelPacker(20)
    for size in rng.integers(1, 20, 400).tolist():
        cost = {}
        for at in [0, *np.flatnonzero(packer.level[:20]).tolist()]:
            if at + size <= 20:
                after = packer.level.copy()
                after[at] -= at > 0
                after[at + size] += at + size < 20
                cost[at] = int((after[1:20] ** 2).sum())
        assert cost[packer.place(size)] == min(cost.values())
        packer.add((0, 0, b"\0\0\0\0" * size, size))
    packer.settle()
    assert sum(sum(len(p[2]) for p in w) < 80 for w in packer.full) <= 1


def test_sequence_files_round_trip(docs, empty, tmp_path):
    from cohortforge.llm.sequence_files import ShardReader, read_documents, write_sequences

    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = write_sequences(docs, path, f"file://{tmp_path}/out", length=64)
    got = [(r.doc_id, r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) for r in read_documents(manifest).collect()]
    got.sort(key=lambda r: (r[1], r[0] is not None))
    order = sorted(samples.rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for (doc_id, at, count, ids), (want_id, text, *_) in zip(got, order, strict=True):
        want = library_ids("word_bpe_49k.json", text) + [1]
        assert (doc_id, at, count, ids) == (want_id, start, len(want), want)
        start += len(want)
    for shard in manifest.collect():
        reader = ShardReader(shard.shard)
        rows = [reader.sequence(i) for i in range(len(reader))]
        assert all(len(ids) == len(mask) == 64 for ids, mask in rows)
        assert sum(int(mask.sum()) for _, mask in rows) == shard.n_ids
        assert np.concatenate([ids for ids, _ in rows])[: shard.n_ids].tolist() == reader.ids(0, shard.n_ids).tolist()
        assert not rows[0][0].flags.owndata
    assert read_documents(write_sequences(empty, path)).count() == 0


def distinct_docs() -> list[tuple[int, str | None]]:
    return sorted({(d, t) for d, t, *_ in samples.rows() if d is not None}, key=str)


def test_line_dedup(docs, empty):
    from cohortforge.llm.line_dedup import dedup_lines

    out = dedup_lines(docs).collect()
    assert len(out) == len(samples.rows()) and out[0].asDict().keys() >= {"score", "n_tokens", "n_lines", "n_removed"}
    want = samples.line_kept([(d, t) for d, t in distinct_docs() if t is not None])
    for r in out:
        if r.doc_id is None or r.doc_id == 6:
            assert r.n_removed == 0 and r.text == (samples.BASE if r.doc_id is None else None)
        else:
            assert r.text == "\n".join(want[r.doc_id]), r.doc_id
    assert next(r for r in out if r.doc_id == 13).text == "x y z\nmore"
    assert dedup_lines(empty).count() == 0
    longer = {r.doc_id: r.n_removed for r in dedup_lines(docs, min_lines=3, min_words=99).collect()}
    assert longer[13] == 0 and longer[14] == 0


def test_substring_dedup(docs, empty):
    from cohortforge.llm.substring_dedup import dedup_substrings

    out = dedup_substrings(docs.withColumnRenamed("score", "n_words")).collect()
    assert len(out) == len(samples.rows())
    want = samples.substring_removed(distinct_docs())
    for r in out:
        if r.doc_id is None:
            assert r.n_removed == 0
            continue
        kept = want[r.doc_id]
        assert r.n_words - r.n_removed == len(kept), r.doc_id
        assert r.kept_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()
        assert sum(x.length for x in r.removed_runs) == r.n_removed and all(x.length >= 13 for x in r.removed_runs)
    removed = {r.doc_id: r.n_removed for r in out}
    assert removed[1] == 120 and removed[5] >= 60 and removed[16] == 0
    assert dedup_substrings(empty).count() == 0


@pytest.mark.parametrize("small", [1000, 3])
def test_near_duplicates(spark, docs, empty, monkeypatch, small):
    from cohortforge.llm import near_dup

    monkeypatch.setattr(near_dup, "SMALL", small)
    monkeypatch.setattr(near_dup, "BRIDGES", 1)
    rows = [(r[0], r[1]) for r in samples.rows()]
    rows += [(100 + i, samples.near(samples.PASSAGE + " " + samples.BASE, [3 + i * 4])) for i in range(12)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n long, rep string")
    out = near_dup.near_duplicates(table).collect()
    want = samples.near_components(sorted({r for r in rows if r[0] is not None}, key=str))
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id), r.doc_id
            assert r.n_shingles == len(samples.shingles(dict(rows)[r.doc_id]))
    assert want[1] == 0 and want[10] == 9 and want[8] == 8
    assert near_dup.near_duplicates(empty).count() == 0


def test_components_of_chains_and_stars(spark):
    from cohortforge.llm.components import components

    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (300, 300), (201, 200), (200, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 140)} == {100}
    assert got[300] == 300 and got[200] == got[201] == 200


ITEMS = [
    (1, samples.PASSAGE),
    (2, "eight words that stand in a text alone"),
    (3, None),
    (4, ""),
    (5, "too short"),
    (6, " ".join(f"z{i}z" for i in range(13))),
    (None, samples.BASE),
]


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_leaks(spark, docs, empty, monkeypatch, limit):
    from cohortforge.llm import decontaminate

    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", limit)
    z = [f"z{i}z" for i in range(13)]
    rows = [(d, t) for d, t in distinct_docs()]
    at = 1000
    for a in range(13):
        for b in range(a + 1, 13, 4):
            changed = [x if i not in (a, b) else "other" for i, x in enumerate(z)]
            rows.append((at, "before it " + " ".join(changed) + " after"))
            at += 1
    rows += [(at, " ".join(x if i not in (1, 5, 9) else "o" for i, x in enumerate(z))), (at + 1, "Eight words\nTHAT stand in a text alone"), (at + 2, " ".join(z[2:]))]
    table = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shift int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    monkeypatch.setattr(decontaminate.hits, "__defaults__", (limit,))
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(table, bench).collect()}
    assert got == samples.leaks(rows, [i for i in ITEMS if i[0] is not None])
    assert {(4, 1), (5, 1), (1000, 6), (at + 1, 2), (at + 2, 6)} <= got and (at, 6) not in got
    assert decontaminate.overlaps(empty, bench).count() == 0 == decontaminate.overlaps(table, bench.limit(0)).count()


def test_leaks_are_found_without_python(spark, docs):
    from cohortforge.llm.decontaminate import overlaps

    plan = overlaps(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


def test_checksums_are_those_of_the_ids(docs):
    from cohortforge.llm.packing import pack

    piece = pack(docs.where("doc_id = 9"), public_tokenizers.path("byte_bpe_50k.json")).withColumn("c", F.crc32("ids")).first()
    ids = np.array(library_ids("byte_bpe_50k.json", "two words") + [1], "<u4")
    assert piece.c == zlib.crc32(ids.tobytes())
