"""Repeated word runs by seed and extend on winnowed anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortforge.llm.tables import drop_table, numbered, written
from cohortforge.llm.text import Words, slices

ANCHOR_WORDS = 5


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` values in a row."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def _selected(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window (its smallest hash of ``ANCHOR_WORDS`` words in a row), and
    whether the window lies in one text."""
    grams, _ = words.grams(ANCHOR_WORDS)
    least = _least(grams, window - ANCHOR_WORDS + 1)
    count = len(least)
    whole = words.doc[:count] == words.doc[window - 1 : window - 1 + count]
    return least, whole


def _anchors(window: int):
    """The distinct anchors of each text, with the text's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                words = Words(texts)
                least, whole = _selected(words, window)
                anchor, doc = least[whole], words.doc[: len(least)][whole]
                # Neighbouring windows mostly share their anchor.
                new = np.ones(len(anchor), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
                anchor, doc = anchor[new], doc[new]
                order = np.lexsort((anchor, doc))
                anchor, doc = anchor[order], doc[order]
                new = np.ones(len(anchor), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
                keys = batch.column(0).slice(at, len(texts)).take(pa.array(doc[new]))
                yield pa.RecordBatch.from_arrays([pa.array(anchor[new].view(np.int64)), keys], names=["anchor", "text_key"])

    return run


def _windows(window: int):
    """Windows around shared anchors: the matches that a seed extends to, by two 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column("text")):
                words = Words(texts)
                least, whole = _selected(words, window)
                shared = batch.column("anchors").slice(at, len(texts))
                taken = np.zeros(len(least), bool)
                for doc in range(len(texts)):
                    part = slice(words.first[doc], max(words.first[doc], words.first[doc + 1] - window + 1))
                    known = shared[doc].values.to_numpy().view(np.uint64)
                    taken[part] = np.isin(least[part], known)
                taken &= whole
                starts = np.flatnonzero(taken)
                first, second = (words.grams(window, seed)[0][starts].view(np.int64) for seed in (1, 2))
                doc = words.doc[starts]
                ids, keys = (batch.column(n).slice(at, len(texts)).take(pa.array(doc)) for n in ("doc_id", "text_key"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first), pa.array(second), ids, keys, pa.array((starts - words.first[doc]).astype(np.int32))],
                    names=["w1", "w2", "doc_id", "text_key", "start"],
                )

    return run


def spans(docs: DataFrame, window: int = 13) -> DataFrame:
    """What to remove of each distinct text: ``text_key, copy_key, rep, starts``.

    ``rep`` is the smallest id with that text; every other document of the text repeats it
    as a whole. ``starts`` are the windows of ``rep`` (by word position) that a document with a
    smaller id also has. ``docs`` has ``doc_id`` (not null), ``text_key``, ``copy_key``, ``text``.

    Seeds are the anchors of at least two texts; texts are joined on them through the
    seeds' first and last key, so a passage of very many texts is never paired out.
    """
    contents = docs.groupBy("text_key", "copy_key").agg(F.min("doc_id").alias("rep"))
    contents = written(contents, "contents")
    schema = "anchor long, text_key long"
    anchors = written(docs.select("text_key", "text").mapInArrow(_anchors(window), schema), "anchors")
    ends = anchors.groupBy("anchor").agg(F.min("text_key").alias("lo"), F.max("text_key").alias("hi"))
    seeds = written(ends.where(F.col("lo") != F.col("hi")).select("anchor"), "seeds")
    held = anchors.join(seeds, "anchor").groupBy("text_key").agg(F.collect_set("anchor").alias("anchors"))
    held = held.join(contents.select("text_key", "rep"), "text_key")
    held = written(held.withColumnRenamed("text_key", "_held"), "seeds-held")
    drop_table(anchors)
    drop_table(seeds)
    on = (docs["doc_id"] == held["rep"]) & (docs["text_key"] == held["_held"])
    seeded = docs.join(held, on).select("doc_id", "text_key", "text", "anchors")
    schema = "w1 long, w2 long, doc_id long, text_key long, start int"
    windows = written(seeded.mapInArrow(_windows(window), schema), "windows")
    drop_table(held)
    firsts = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    firsts = written(firsts.where(F.col("lo") != F.col("hi")).drop("hi"), "window-firsts")
    later = windows.join(firsts, ["w1", "w2"]).where(F.col("doc_id") > F.col("lo"))
    later = later.groupBy(F.col("doc_id").alias("rep"), "text_key").agg(F.collect_set("start").alias("starts"))
    later = written(later, "window-spans")
    drop_table(windows)
    drop_table(firsts)
    return contents.join(later, ["rep", "text_key"], "left")


def _cleaned(window: int, names: list[str], text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column("_text")):
                words = Words(texts)
                starts = batch.column("_starts").slice(at, len(texts))
                repeats = batch.column("_repeats").slice(at, len(texts)).to_pylist()
                original = batch.column(text_at).slice(at, len(texts))
                n_words = np.diff(words.first)
                n_removed, kept, digest, runs = np.zeros(len(texts), int), [], [], []
                data = words.data.tobytes()
                for doc in range(len(texts)):
                    lo, size = words.first[doc], n_words[doc]
                    gone = np.full(size, repeats[doc] and size >= window)
                    if starts[doc].is_valid:
                        begin, edge = starts[doc].values.to_numpy(), np.zeros(size + 1, np.int64)
                        edge[begin] += 1
                        np.add.at(edge, begin + window, -1)
                        gone = np.cumsum(edge)[:size] > 0
                    n_removed[doc] = gone.sum()
                    left = np.flatnonzero(~gone) + lo
                    text = b" ".join([data[a:b] for a, b in zip(words.start[left].tolist(), words.end[left].tolist(), strict=True)])
                    digest.append(hashlib.sha256(text).hexdigest())
                    kept.append(text.decode() if n_removed[doc] else original[doc].as_py())
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    runs.append([{"start": int(a), "length": int(b - a)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
                columns = [batch.column(n).slice(at, len(texts)) for n in range(len(names))]
                columns[text_at] = pa.array(kept, pa.string())
                run_type = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest), pa.array(runs, run_type)],
                    names=[*names, "n_words", "n_removed", "kept_sha256", "removed_runs"],
                )

    return run


def dedup_substrings(
    docs: DataFrame, window: int = 13, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """All rows and columns of ``docs`` without words that repeat an earlier document.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A word goes if a window of ``window``
    words of its document holds it whose words also start somewhere in a document with a
    smaller id, judged on the input. Adds ``n_words, n_removed, kept_sha256`` (of the kept
    words, joined by one blank) and ``removed_runs`` (maximal runs of removed words); a text with removed
    words becomes the kept ones, joined by one blank, others stay as they are.

    Any two equal windows have the same anchor, so no match is missed; matches are told by
    128 bits of hash. Equal texts are told by 128 bits too, and only the one of the smallest
    id is searched. A null text has no words; rows with a null id are neither compared
    nor changed; rows that repeat an id never match each other; an empty table gives an
    empty result; columns named like an added one are replaced.
    """
    added = ("n_words", "n_removed", "kept_sha256", "removed_runs")
    names = [c for c in docs.columns if c not in added]
    text = F.coalesce(docs[text_column], F.lit(""))
    keys = [F.xxhash64(text), F.xxhash64(F.lit("copy"), text)]
    doc_id = docs[id_column].cast("long")
    plain = docs.where(doc_id.isNotNull()).select(
        doc_id.alias("doc_id"), keys[0].alias("text_key"), keys[1].alias("copy_key"), text.alias("text")
    )
    marks = written(spans(plain, window), "text-marks")
    # Rows with a null id look up nothing.
    seen = [F.when(doc_id.isNotNull(), k) for k in keys]
    keyed = numbered(docs, names, _text=text, _id=doc_id, _k1=seen[0], _k2=seen[1])
    on = (keyed["_k1"] == marks["text_key"]) & (keyed["_k2"] == marks["copy_key"])
    joined = keyed.join(marks, on, "left")
    repeats = F.coalesce(F.col("_id") > F.col("rep"), F.lit(False))
    own = [f"_{n}" for n in range(len(names))]
    joined = joined.select(*own, "_text", F.when(~repeats, F.col("starts")).alias("_starts"), repeats.alias("_repeats"))
    more = "n_words long, n_removed long, kept_sha256 string, removed_runs array<struct<start:int,length:int>>"
    schema = StructType([*docs.select(*names).schema.fields, *StructType.fromDDL(more).fields])
    return joined.mapInArrow(_cleaned(window, names, names.index(text_column)), schema)


DEDUP_SQL = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws
  FROM documents
), p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS s FROM d),
w AS (SELECT doc_id, s, array_to_string(ws[s:s + 12], ' ') AS run FROM p),
f AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY run) < doc_id AS again FROM w),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS i FROM f WHERE again),
h AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id),
k AS (
  SELECT d.doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed,
    CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(gone, i)) END AS kept
  FROM d LEFT JOIN h ON d.doc_id = h.doc_id
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256
FROM k
"""
