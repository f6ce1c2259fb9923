"""Sum-of-squares online packing of token sequences."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from cohortforge.llm.segments import SegmentEncoder, as_ids, encoder
from cohortforge.llm.text import give_back, slices

PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
)
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)
#: Sequence ids of one task start at its partition number times this.
SEQUENCES_PER_TASK = 1 << 33


class LevelPacker:
    """Windows of ``capacity`` ids, filled by the sum-of-squares rule.

    ``level[h]`` counts the open windows that hold h ids. A piece of s ids goes to the
    level h, or to a new window, for which the sum of squared counts grows least; among
    equals to the fullest. At most ``most_open`` windows stay open: beyond that, and at
    the end, ``settle`` closes them by cutting.
    """

    def __init__(self, capacity: int, most_open: int = 4096):
        self.capacity = capacity
        self.most_open = most_open
        self.level = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[list]] = defaultdict(list)
        self.full: list[list] = []

    def place(self, size: int) -> int:
        """The fill level that takes a piece of ``size`` ids; 0 is a new window."""
        top = self.capacity - size
        growth = 2 * (self.level[size : self.capacity + 1] - self.level[: top + 1]) + 2
        growth[0] -= 1
        growth[top] -= 1
        usable = self.level[: top + 1] > 0
        usable[0] = True
        growth[~usable] = np.iinfo(np.int64).max
        return int(top - np.argmin(growth[::-1]))

    def add(self, piece: tuple) -> None:
        """Take one piece ``(doc_id, start, ids, doc_tokens)`` of at most ``capacity`` ids."""
        size = len(piece[2]) // 4
        if size == self.capacity:
            self.full.append([piece])
            return
        at = self.place(size)
        window = self.open[at].pop() if at else []
        if at:
            self.level[at] -= 1
        window.append(piece)
        if at + size == self.capacity:
            self.full.append(window)
            return
        self.level[at + size] += 1
        self.open[at + size].append(window)
        if self.level.sum() > self.most_open:
            self.settle(keep_last=True)

    def settle(self, keep_last: bool = False) -> None:
        """Fill the fullest open windows with pieces of the emptiest, cut to fit."""
        windows = [w for at in sorted(self.open, reverse=True) for w in self.open[at]]
        fill = [sum(len(p[2]) // 4 for p in w) for w in windows]
        left, right = 0, len(windows) - 1
        while left < right:
            gap = self.capacity - fill[left]
            doc_id, start, ids, total = windows[right].pop()
            size = len(ids) // 4
            if size > gap:
                windows[right].append((doc_id, start + gap, ids[4 * gap :], total))
                ids, size = ids[: 4 * gap], gap
            windows[left].append((doc_id, start, ids, total))
            fill[left] += size
            fill[right] -= size
            if fill[left] == self.capacity:
                left += 1
            if fill[right] == 0:
                right -= 1
        self.level[:] = 0
        self.open.clear()
        for window, size in zip(windows, fill, strict=True):
            if size == self.capacity or (size and not keep_last):
                self.full.append(window)
            elif size:
                self.level[size] += 1
                self.open[size].append(window)


def _packer(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def rows(windows: list[list], first: int) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in _ARROW]
        for number, window in enumerate(windows):
            offset = 0
            for doc_id, start, ids, total in window:
                size = len(ids) // 4
                for column, value in zip(
                    columns, (doc_id, start, size, ids, total, first + number, offset), strict=True
                ):
                    column.append(value)
                offset += size
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW
        )

    def packed(batches: Iterator[pa.RecordBatch], encode: SegmentEncoder) -> Iterator[pa.RecordBatch]:
        packer = LevelPacker(capacity)
        sequence = TaskContext.get().partitionId() * SEQUENCES_PER_TASK
        for batch in batches:
            for at, texts in slices(batch.column(1), 2 << 20):
                ids = batch.column(0).slice(at, len(texts)).to_pylist()
                tokens, first = encode.batch(texts)
                for doc_id, a, b in zip(ids, first[:-1].tolist(), first[1:].tolist(), strict=True):
                    encoded = tokens[a:b].astype("<u4").tobytes() + end
                    total = len(encoded) // 4
                    for start in range(0, total, capacity):
                        packer.add((doc_id, start, encoded[4 * start : 4 * (start + capacity)], total))
                    if len(packer.full) >= 512:
                        yield rows(packer.full, sequence)
                        sequence += len(packer.full)
                        packer.full = []
        packer.settle()
        if packer.full:
            yield rows(packer.full, sequence)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The worker lives on after the task, so its known segments go with the task.
        encode = encoder(path)
        try:
            yield from packed(batches, encode)
        finally:
            encode.forget()
            give_back()

    return run


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    end_id: int = 1,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most ``capacity`` ids.

    Per piece: ``doc_id, start, length, ids`` (little-endian unsigned 32-bit), ``doc_tokens``
    (ids of the whole document, with the end id), ``sequence_id`` and ``offset`` in it.

    Each task packs the documents of its input partition as they stream by: full windows
    leave at once, a level array counts the open ones, and no ids are shuffled. Every
    partition ends with one window at most that isn't full. Ids of a document longer than
    ``capacity`` fill windows of their own and only the rest is placed.

    A null text is one end id; null ids stay null; repeated rows are packed each for
    itself; an empty table gives no pieces; other columns are not read.
    """
    columns = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    return columns.mapInArrow(_packer(tokenizer_path, capacity, end_id), PIECES)


def unpacked(pieces: list[tuple[int, bytes]]) -> np.ndarray:
    """Ids of one document from its ``(start, ids)`` pieces."""
    parts = [as_ids(ids) for _, ids in sorted(pieces)]
    return np.concatenate(parts) if parts else np.zeros(0, "<u4")
