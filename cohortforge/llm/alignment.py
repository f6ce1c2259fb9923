"""Alignment of two tokenizers by lockstep vectorised merging of their token ends."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortforge.llm.tables import written
from cohortforge.llm.text import slices
from cohortforge.llm.token_pairs import TokenPair, token_pair

#: Segments of a document that one lane of the merge takes.
LANE = 24
#: Groups with more links are counted by distinct ids, not link by link.
LARGE = 4096
#: Bytes of text that share one lookup of pair counts.
CHUNK_BYTES = 8 << 20
DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of several ranges in a row."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


def lockstep(a_end: np.ndarray, b_end: np.ndarray, a_lane: np.ndarray, b_lane: np.ndarray):
    """Merge the token ends of all lanes at once.

    ``a_end`` and ``b_end`` are the byte ends of the tokens, lanes one after the other; lane n has the A tokens from
    ``a_lane[n]`` to ``a_lane[n + 1]`` and likewise B, over the same bytes. A step moves the pointer that is behind in
    each lane, or both where they meet; there a group ends. Lanes that are through leave the state.

    Yields, step by step, the groups that end: first A token, end of A, first B token, end of B.
    """
    lanes = np.flatnonzero(np.diff(a_lane) > 0)
    a, b = a_lane[lanes], b_lane[lanes]
    a_from, b_from, a_stop = a.copy(), b.copy(), a_lane[lanes + 1]
    while len(a):
        to_a, to_b = a_end[a], b_end[b]
        a = a + (to_a <= to_b)
        b = b + (to_b <= to_a)
        met = np.flatnonzero(to_a == to_b)
        if len(met):
            yield a_from[met], a[met], b_from[met], b[met]
            a_from[met], b_from[met] = a[met], b[met]
            going = a < a_stop
            # Compacting pays once a good part of the lanes is through; until then the rest stay as they are.
            if not going.all():
                a, b, a_from, b_from, a_stop = a[going], b[going], a_from[going], b_from[going], a_stop[going]


class Aligned:
    """Groups and links of a batch of texts; the first group, token and pair of each text with one more entry for the end."""

    def __init__(self, pair: TokenPair, texts: pa.Array):
        count = len(texts)
        segment, doc = pair.segments(texts)
        usable = pc.greater(pc.binary_length(texts), 0).fill_null(False).to_numpy(zero_copy_only=False)
        usable[doc[~pair.right[segment]]] = False
        taken = usable[doc]
        segment, doc = segment[taken], doc[taken]
        self.ids, end, self.first, lane = [], [], [], []
        number = np.arange(len(doc)) - np.searchsorted(doc, doc)
        opens = np.flatnonzero(number % LANE == 0)
        for n in range(2):
            begin, size = pair.ends[n][segment], np.diff(pair.ends[n])[segment]
            ids = pair.ids[n][ranges(begin, size)]
            ends = np.concatenate([[0], np.cumsum(size)])
            self.ids.append(ids)
            end.append(np.cumsum(pair.sizes[n][ids]))
            self.first.append(ends[np.searchsorted(doc, np.arange(count + 1))])
            lane.append(np.append(ends[opens], ends[-1]))
        a_last, b_last = np.zeros(len(self.ids[0]), bool), np.zeros(len(self.ids[1]), bool)
        links: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a_from, a_to, b_from, b_to in lockstep(*end, *lane):
            a_last[a_to - 1], b_last[b_to - 1] = True, True
            self._link(links, a_from, a_to - a_from, b_from, b_to - b_from)
        self.cut = [np.append(0, np.flatnonzero(last) + 1) for last in (a_last, b_last)]
        self.last = (a_last, b_last)
        self.groups = np.searchsorted(self.cut[0], self.first[0])
        token, code, times = (np.concatenate([x[i] for x in links]) if links else np.zeros(0, np.int64) for i in range(3))
        owner = np.searchsorted(self.first[0][1:], token, side="right")
        self.links = np.bincount(owner, times, count).astype(np.int64)
        self._distinct(owner, code, times, count)

    def _link(self, links: list, a_from: np.ndarray, a_size: np.ndarray, b_from: np.ndarray, b_size: np.ndarray) -> None:
        """All A-B pairs of the groups: an A token of the document, the pair's code, how often."""
        a_ids, b_ids = self.ids
        product = a_size * b_size
        for group in np.flatnonzero(product > LARGE).tolist():
            a, a_times = np.unique(a_ids[a_from[group] : a_from[group] + a_size[group]], return_counts=True)
            b, b_times = np.unique(b_ids[b_from[group] : b_from[group] + b_size[group]], return_counts=True)
            code = ((a[:, None] << 32) | b).ravel()
            links.append((np.full(len(code), a_from[group]), code, np.outer(a_times, b_times).ravel()))
        small = np.flatnonzero(product <= LARGE)
        within = ranges(np.zeros(len(small), np.int64), product[small])
        wide = np.repeat(b_size[small], product[small])
        a = np.repeat(a_from[small], product[small]) + within // wide
        b = np.repeat(b_from[small], product[small]) + within % wide
        links.append((a, (a_ids[a] << 32) | b_ids[b], np.ones(len(a), np.int64)))

    def _distinct(self, owner: np.ndarray, code: np.ndarray, times: np.ndarray, count: int) -> None:
        """Distinct pairs of each text with the number of links."""
        codes = pa.array(code).dictionary_encode()
        values = codes.dictionary.to_numpy()
        keys = pa.array(owner * max(1, len(values)) + codes.indices.to_numpy()).dictionary_encode()
        total = np.bincount(keys.indices.to_numpy(), times, len(keys.dictionary)).astype(np.int64)
        key = keys.dictionary.to_numpy()
        order = np.argsort(key)
        key, self.times = key[order], total[order]
        self.pairs = values[key % max(1, len(values))]
        self.pair_first = np.searchsorted(key // max(1, len(values)), np.arange(count + 1))

    def digests(self, pair: TokenPair) -> list[str]:
        """SHA-256 of each text's groups ``a1,a2|b1;a3|b2,b3`` in decimal ids; empty without tokens."""
        index = np.zeros(len(self.ids[0]) + len(self.ids[1]), np.int64)
        for n in range(2):
            group = np.cumsum(self.last[n]) - self.last[n]
            place = np.arange(len(group)) + self.cut[1 - n][group + n]
            index[place] = pair.bases[n] + self.ids[n] + self.last[n] * len(pair.sides[n].tokens)
        strings = pair.decimal.take(pa.array(index))
        data, offsets = bytes_with_offsets(strings)
        begin = offsets[self.first[0] + self.first[1]]
        return [hashlib.sha256(data[a : b - 1]).hexdigest() if b > a else "" for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]


def bytes_with_offsets(strings: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of a large-string column in a row, and where each value begins."""
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    return memoryview(strings.buffers()[2] or b""), offsets


def _aligned(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = token_pair(a_path, b_path)
        context = TaskContext.get()
        chunk, filled = (context.partitionId() if context else 0) << 32, 0
        try:
            for batch in batches:
                for at, texts in slices(batch.column(1), 2 << 20):
                    found = Aligned(pair, texts)
                    if filled > CHUNK_BYTES:
                        chunk, filled = chunk + 1, 0
                    filled += texts.nbytes
                    firsts = pa.array(found.pair_first, pa.int32())
                    columns = [
                        pa.array(np.full(len(texts), chunk)),
                        batch.column(0).slice(at, len(texts)),
                        *[pa.array(np.diff(first)) for first in (*found.first, found.groups)],
                        pa.array(found.links),
                        pa.array(found.digests(pair)),
                        pa.ListArray.from_arrays(firsts, pa.array(found.pairs)),
                        pa.ListArray.from_arrays(firsts, pa.array(found.times)),
                    ]
                    yield pa.RecordBatch.from_arrays(
                        columns, names=["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
                    )
        finally:
            pair.clear()

    return run


def _chunk_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many rows of each chunk a pair stands, batch by batch."""
    for batch in batches:
        lists = batch.column(1)
        pairs = pa.table({"chunk": np.repeat(batch.column(0).to_numpy(), np.diff(lists.offsets.to_numpy())), "pair": lists.flatten()})
        counts = pairs.group_by(["chunk", "pair"]).aggregate([([], "count_all")]).combine_chunks()
        yield from counts.rename_columns(["chunk", "pair", "docs"]).to_batches()


def _looked_up(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """``n_best`` and ``count_sum`` of the documents of one chunk."""
    counts = counts.sort_by("pair")
    known, total, best = (counts[c].to_numpy() for c in ("pair", "count", "best"))
    lists = docs["pairs"].combine_chunks()
    at = np.searchsorted(known, lists.flatten().to_numpy())
    times = docs["times"].combine_chunks().flatten().to_numpy()
    first = lists.offsets.to_numpy() - lists.offsets.to_numpy()[0]
    sums = [np.concatenate([[0], np.cumsum(times * x[at])])[first] for x in (best.astype(np.int64), total)]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    out = {name: docs[name] for name in names} | {"n_best": np.diff(sums[0]), "count_sum": np.diff(sums[1])}
    return pa.table(out | {"groups_sha256": docs["groups_sha256"]})


def linked_tokens(docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each document's alignment: counts, ``groups_sha256``, distinct linked id ``pairs`` (A id << 32 | B id) and their ``times``.

    ``chunk`` names the stretch of about ``CHUNK_BYTES`` of text that a document was read in.
    """
    plain = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    return plain.mapInArrow(_aligned(a_path, b_path), f"chunk long, {DIGEST}, pairs array<long>, times array<long>")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """``pair, count, best``: documents that hold a pair linked, and whether no pair of its A id has more.

    ``pairs`` has ``pair, docs``, already summed up in parts.
    """
    totals = written(pairs.groupBy("pair").agg(F.sum("docs").alias("count")), "pair-counts")
    a_id = F.shiftright("pair", 32)
    # One row per id of A's vocabulary.
    most = totals.groupBy(a_id.alias("_a")).agg(F.max("count").alias("_most"))
    return totals.join(most, a_id == F.col("_a")).select("pair", "count", (F.col("count") == F.col("_most")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per input row the alignment of two tokenizers: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A is a byte-level file of the tokenizers library, given a blank and the text; B a sentencepiece model, which
    puts the blank there itself. Strings of special tokens are plain text. Byte offsets where tokens of both end
    cut them into groups; every A token of a group is linked to every B token of it. A pair of ids
    counts as many documents as hold it linked. ``n_best`` are the links whose pair has the highest count of its A id,
    ties included; ``count_sum`` adds the counts up over the links.

    1. Documents of a batch are merged in lockstep, each as lanes of ``LANE`` segments that begin where both tokenizers
       begin a token for sure; this gives groups, links and each document's distinct pairs.
    2. Pairs are summed up within chunks of documents, and over all chunks.
    3. A chunk's counts meet its documents again, so counts are looked up once a chunk, not once a link.

    Null and empty texts, and those that either tokenizer doesn't give back byte by byte, have no tokens: zeros and an
    empty digest. Null ids and repeated rows are rows like others, and each counts as a document. An empty table
    gives an empty result; other columns are not read.
    """
    found = written(linked_tokens(docs, a_path, b_path, id_column, text_column), "linked-tokens")
    parts = found.select("chunk", "pairs").mapInArrow(_chunk_pairs, "chunk long, pair long, docs long")
    parts = written(parts.groupBy("chunk", "pair").agg(F.sum("docs").alias("docs")), "chunk-pairs")
    counts = parts.select("chunk", "pair").join(pair_counts(parts.select("pair", "docs")), "pair")
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return found.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(_looked_up, out)
