"""Periodic runs of words by maximal-pair enumeration over LCP-interval trees."""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortforge.llm.tables import numbered
from cohortforge.llm.text import Words, slices

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
ADDED = """n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string,
collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>, collapsed string"""


def made_periodic(ids: pa.Array, first: np.ndarray) -> np.ndarray:
    """Which word stands at each place once the documents with crc32(id) % 10 = 0 are made periodic.

    With h the crc32 of the decimal id, g = h // 10 and n words, each word i from a = g % n on becomes
    word a + (i - a) % p, where p = 1 + (n - a) // (3 + g % 8). Rows with a null id stay.
    """
    source = np.arange(first[-1])
    for row, doc_id in enumerate(ids.to_pylist()):
        n = int(first[row + 1] - first[row])
        h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h % 10 or not n:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        source[first[row] + a : first[row + 1]] = first[row] + a + np.arange(n - a) % p
    return source


def word_numbers(words: Words) -> np.ndarray:
    """A number for each word, equal for equal bytes only."""
    data = words.data
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    ends = np.concatenate([[0], np.cumsum(words.end - words.start)])
    buffers = [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[inside])]
    column = pa.Array.from_buffers(pa.large_binary(), len(words.start), buffers)
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def suffix_array(word: np.ndarray, doc: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of each document in order, with the common prefix of each and the one before it.

    Prefix doubling over all documents of a batch at once; ``ends`` is the end of each place's document. Places
    whose prefix is unique leave. Only stretches of suffixes with ``least`` words in common are
    returned; the first suffix of a stretch has a common prefix of 0.
    """
    n = len(word)
    key = doc.astype(np.int64) * (int(word.max(initial=0)) + 1) + word
    order = np.argsort(key, kind="stable")
    slots, rank, size = np.arange(n), np.zeros(n, np.int64), 1
    first = np.ones(n, bool)
    first[1:] = key[order[1:]] != key[order[:-1]]
    levels, member = [], order
    while True:
        group = np.flatnonzero(first)
        rank[member] = np.repeat(slots[group], np.diff(np.append(group, len(slots))))
        many = np.repeat(np.diff(np.append(group, len(slots))) > 1, np.diff(np.append(group, len(slots))))
        order[slots] = member
        slots, member = slots[many], member[many]
        if not len(slots):
            break
        levels.append((member, rank[member]))
        follows = member + size
        second = np.where(follows < ends[member], rank[np.minimum(follows, n - 1)] + 1, 0)
        sorted_ = np.argsort(rank[member] * (n + 1) + second, kind="stable")
        member, second = member[sorted_], second[sorted_]
        first = np.ones(len(slots), bool)
        first[1:] = (rank[member[1:]] != rank[member[:-1]]) | (second[1:] != second[:-1])
        size *= 2
    low = least.bit_length() - 1
    if len(levels) <= low:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Neighbours that agree in the largest power of two within ``least`` words.
    name = -np.arange(1, n + 2)
    name[levels[low][0]] = levels[low][1]
    at = np.flatnonzero(name[order[1:]] == name[order[:-1]]) + 1
    x, y = order[at - 1], order[at]
    common = np.zeros(len(at), np.int64)
    for step in range(len(levels) - 1, -1, -1):
        name = -np.arange(1, n + 2)
        name[levels[step][0]] = levels[step][1]
        equal = (name[x] == name[y]) << step
        x, y, common = x + equal, y + equal, common + equal
    at, common = at[common >= least], common[common >= least]
    lcp = np.zeros(n + 1, np.int64)
    lcp[at] = common
    shown = np.flatnonzero((lcp[:-1] > 0) | (lcp[1:] > 0))
    return order[shown], lcp[shown]


def maximal_pairs(suffixes: list[int], lcp: list[int], left: Callable[[int], int], ratio: int) -> list[tuple[int, int, int]]:
    """Maximal pairs ``(i, j, l)`` of places whose distance is ``l / ratio`` at most, bottom-up over the LCP intervals.

    A node is the list of its places in order, each with its left word as its class. A child joins
    its node by looking its places up in the larger list: words differ on the right, as
    the children do; pairs of one class are not maximal on the left. Of the places so near to one
    another, all but the first of a chain are of the class of the period's last word, so the
    nearest place on either side is the only one that can be a smallest period apart.
    """
    found: list[tuple[int, int, int]] = []

    def joined(one: list[int], other: list[int], depth: int) -> list[int]:
        small, large = (one, other) if len(one) < len(other) else (other, one)
        reach = depth // ratio
        for place in small:
            at = bisect_left(large, place)
            if at and place - large[at - 1] <= reach and left(large[at - 1]) != left(place):
                found.append((large[at - 1], place, depth))
            if at < len(large) and large[at] - place <= reach and left(large[at]) != left(place):
                found.append((place, large[at], depth))
        if len(small) <= 4:
            for place in small:
                insort(large, place)
        else:
            large += small
            large.sort()
        return large

    stack: list[tuple[int, list[int]]] = []
    node: list[int] = []
    for place, depth in zip(suffixes, lcp, strict=True):
        while stack and stack[-1][0] > depth:
            top, places = stack.pop()
            node = joined(places, node, top)
        if stack and stack[-1][0] == depth:
            stack[-1] = (depth, joined(stack[-1][1], node, depth))
        elif depth:
            stack.append((depth, node))
        node = [place]
    while stack:
        top, places = stack.pop()
        node = joined(places, node, top)
    return found


def find_runs(word: np.ndarray, first: np.ndarray, least: int = 6, exponent: int = 4) -> np.ndarray:
    """Runs of a batch as rows ``start, length, period`` (start over the whole batch), by start, then period.

    A maximal pair at distance p with l words in common is a stretch of l + p words with period p that no
    neighbour extends. Where p isn't its smallest period, that one gives the same stretch, so the
    least period of a stretch stays.
    """
    if exponent < 3:
        raise ValueError("runs of fewer than three periods are not told by near pairs")
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    shortest = min(max(least - p, (exponent - 1) * p) for p in range(1, max(2, least)))
    suffixes, lcp = suffix_array(word, doc, first[1:][doc], shortest)
    before = np.concatenate([[-1], word[:-1]])
    starts = first[:-1][np.diff(first) > 0]
    before[starts] = -1
    pairs = np.array(maximal_pairs(suffixes.tolist(), lcp.tolist(), before.tolist().__getitem__, exponent - 1), np.int64).reshape(-1, 3)
    period = pairs[:, 1] - pairs[:, 0]
    rows = np.column_stack([pairs[:, 0], pairs[:, 2] + period, period])[pairs[:, 2] + period >= least]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[new]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _joined_words(words: Words, taken: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the taken words, each with a blank behind it, and where the words at ``bounds`` begin in them."""
    begin = words.start[taken]
    size = words.end[taken] - begin + 1
    ends = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(ends[-1]) + np.repeat(begin - ends[:-1], size)
    data = np.append(words.data, np.uint8(32))[at]
    data[ends[1:] - 1] = 32
    return data, ends[bounds]


def _best(runs: list[list[int]]) -> list[int] | None:
    """The run with the greatest length / period; ties go to the smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _found(kept: int, names: list[str], rewrite, least: int, exponent: int, with_text: bool):
    """Adds the found columns to the first ``kept`` ones; the id and the text follow these. ``names`` are the results'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(kept + 1), 2 << 20):
                words = Words(texts)
                first, count = words.first, len(texts)
                source = np.arange(first[-1])
                if rewrite is not None:
                    source = rewrite(batch.column(kept).slice(at, count), first)
                runs = find_runs(word_numbers(words)[source], first, least, exponent)
                edge = np.zeros(first[-1] + 1, np.int64)
                np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
                np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
                stay = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
                data, offsets = _joined_words(words, source[stay], np.searchsorted(stay, first))
                data = memoryview(data.tobytes())
                owner = np.searchsorted(runs[:, 0], first)
                rows, best, run_digests, digests, collapsed = [], [], [], [], []
                for row in range(count):
                    own = runs[owner[row] : owner[row + 1]] - np.array([first[row], 0, 0])
                    own = own.tolist()
                    best.append(_best(own) or [None] * 3)
                    run_digests.append(hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in own).encode()).hexdigest())
                    text = data[offsets[row] : max(offsets[row], offsets[row + 1] - 1)]
                    digests.append(hashlib.sha256(text).hexdigest())
                    rows.append([{"start": s, "length": n, "period": p} for s, n, p in own])
                    collapsed.append(str(text, "utf-8") if with_text else None)
                start, length, period = (pa.array([b[i] for b in best], pa.int64()) for i in range(3))
                milli = pa.array([None if b[0] is None else 1000 * b[1] // b[2] for b in best], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(n).slice(at, count) for n in range(kept)],
                        pa.array(np.diff(owner)),
                        start,
                        length,
                        period,
                        milli,
                        pa.array(run_digests),
                        pa.array(digests),
                        pa.array(rows, pa.list_(RUN)),
                        pa.array(collapsed, pa.string()),
                    ],
                    names=names,
                )

    return run


def periodic_runs(
    docs: DataFrame,
    rewrite: Callable[[pa.Array, np.ndarray], np.ndarray] | None = None,
    least: int = 6,
    exponent: int = 4,
    with_text: bool = True,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """All rows of ``docs`` with the periodic runs of their words; the text gives way to ``collapsed``.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a stretch with smallest period q of at least
    ``least`` and ``exponent`` * q words that no neighbouring word extends. Adds ``n_runs``; ``start,
    length, period, exponent_milli`` of the run with the greatest length / period (ties: smallest start, then
    period; nulls without a run); ``runs`` by start, then period, and ``runs_sha256`` of their lines
    ``start,length,period``; ``collapsed``, the words outside what any run holds after its first q words, joined by one
    blank (null unless ``with_text``), and ``collapsed_sha256``. ``rewrite`` may put other words of
    the same batch at a place first, see ``made_periodic``.

    Each document is searched by itself, in batches of bounded bytes; a longer document is a batch of its own, and
    nothing is shuffled. A null, empty or blank text has no words and no run; null ids and repeated rows are kept as they
    are; an empty table gives an empty result; columns named like an added one are replaced.
    """
    added = StructType.fromDDL(ADDED)
    names = [c for c in docs.columns if c not in added.names and c != text_column]
    text = F.coalesce(docs[text_column].cast("string"), F.lit(""))
    rows = numbered(docs, names, run_id=docs[id_column], run_text=text)
    schema = StructType([*docs.select(*names).schema.fields, *added.fields])
    return rows.mapInArrow(_found(len(names), schema.names, rewrite, least, exponent, with_text), schema)
