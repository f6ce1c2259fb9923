"""Words, rolling hashes and shingles of Arrow text batches, without a Python loop per word."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_STEP = np.uint64(0x9E3779B97F4A7C15)
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict[str, np.ndarray] = {}


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (one to one)."""
    with np.errstate(over="ignore"):
        out = values ^ (values >> np.uint64(32))
        out = out * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
        out = out * np.uint64(0xA0761D6478BD642F)
        out ^= out >> np.uint64(29)
    return out


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    have = _POWERS.get("up")
    if have is None or len(have) < size:
        size = max(1 << 16, 1 << (size - 1).bit_length())
        inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
        with np.errstate(over="ignore"):
            for name, base in (("up", _STEP), ("down", inverse)):
                factors = np.full(size, base, np.uint64)
                factors[0] = 1
                _POWERS[name] = np.multiply.accumulate(factors)
    return _POWERS["up"], _POWERS["down"]


def slices(texts: pa.Array, most: int = 4 << 20, rows: int = 4096) -> Iterator[tuple[int, pa.Array]]:
    """Cut a text column into runs of about ``most`` bytes and ``rows`` texts; a longer text is a run of its own."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, base + most, side="right"))))
        yield at, texts.slice(at, to - at)
        at = to


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a large-string column without nulls, and where each text begins (one more for the end)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    everything = np.frombuffer(buffer, np.uint8) if buffer else np.zeros(0, np.uint8)
    return everything[offsets[0] : offsets[-1]], offsets - offsets[0]


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes from each start to its end."""
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        return mix((sums[end] - sums[start]) * down[start])


def give_back() -> None:
    """Return the freed memory of this worker to the system, where the allocators can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a run of texts.

    ``hash`` is a 64-bit hash of each word's bytes, ``doc`` the index of its text in the
    run, ``start`` and ``end`` its bytes in ``data``; ``first`` has the index of each
    text's first word, with one more entry for the end.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        data, offsets = bytes_of(texts)
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        opens[edges] |= inside[edges]
        closes[edges - 1] |= inside[edges - 1]
        self.data = data
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.doc = np.searchsorted(offsets[1:], self.start, side="right").astype(np.int32)
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self.hash = hash_spans(data, self.start, self.end)

    def grams(self, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``size`` words from each position, and whether they lie in one text."""
        count = max(0, len(self.hash) - size + 1)
        total = np.full(count, np.uint64(seed), np.uint64)
        with np.errstate(over="ignore"):
            for step in range(size):
                total = total * _GRAM + self.hash[step : step + count]
        whole = self.doc[:count] == self.doc[size - 1 : size - 1 + count]
        return mix(total), whole
