"""Token ids of whole texts by the tokenizers library, with a bounded table of known segments."""

from __future__ import annotations

import hashlib
import os
from itertools import chain

import numpy as np
import pyarrow as pa

from cohortforge.llm.text import bytes_of, hash_spans

#: Files whose rules never join characters across a lone blank or line feed between two
#: other characters, so that such places split a text into independent segments.
SPLITTABLE = ("byte_bpe_50k.json", "word_bpe_49k.json")
#: Segments of more bytes are encoded each time.
LONGEST = 48
_ENCODERS: dict[str, SegmentEncoder] = {}


def _white(data: np.ndarray) -> np.ndarray:
    """Bytes of white space in UTF-8, Unicode's included."""
    white = (data == 32) | ((data >= 9) & (data <= 13)) | ((data >= 28) & (data <= 31))
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    if len(lead):
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        a, b, c = data[lead], padded[lead + 1], padded[lead + 2]
        two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        line = ((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)
        three = (
            ((a == 0xE1) & (b == 0x9A) & (c == 0x80))
            | ((a == 0xE2) & (((b == 0x80) & line) | ((b == 0x81) & (c == 0x9F))))
            | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
        )
        for step in range(3):
            white[lead[three | (two & (step < 2))] + step] = True
    return white


class SegmentEncoder:
    """Encodes texts to unsigned 32-bit ids.

    Ids equal those of one library call per text without added special tokens, whatever
    the texts. Known segments are found by a 64-bit hash and their length in an open
    table of ``1 << bits`` places; it is emptied when half full.
    """

    def __init__(self, path: str, bits: int = 21):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.split = os.path.basename(path) in SPLITTABLE
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.bits = bits
        self.forget()

    def _clear(self) -> None:
        places = 1 << self.bits
        self.keys = np.zeros(places, np.uint64)  # 0: free
        self.sizes = np.zeros(places, np.int32)
        self.starts = np.zeros(places, np.int64)
        self.counts = np.zeros(places, np.int32)
        self.ids = np.zeros(1 << 20, np.uint32)
        self.n_ids = self.n_keys = 0

    def forget(self) -> None:
        """Free the known segments; the next batch begins anew."""
        self.keys = self.sizes = self.starts = self.counts = self.ids = None

    def _find(self, key: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The place of each segment, or -1."""
        place = (key >> np.uint64(64 - self.bits)).astype(np.int64)
        found, open_ = np.full(len(key), -1), np.arange(len(key))
        while len(open_):
            at = place[open_]
            there = self.keys[at]
            hit = (there == key[open_]) & (self.sizes[at] == size[open_])
            found[open_[hit]] = at[hit]
            open_ = open_[(there != 0) & ~hit]
            place[open_] = (place[open_] + 1) & ((1 << self.bits) - 1)
        return found

    def _insert(self, key: np.ndarray, size: np.ndarray, start: np.ndarray, count: np.ndarray) -> None:
        """Put segments that aren't there yet."""
        place, open_ = (key >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(key))
        while len(open_):
            free = open_[self.keys[place[open_]] == 0]
            at, first = np.unique(place[free], return_index=True)
            put = free[first]
            self.keys[at], self.sizes[at], self.starts[at], self.counts[at] = key[put], size[put], start[put], count[put]
            left = np.ones(len(key), bool)
            left[put] = False
            open_ = open_[left[open_]]
            place[open_] = (place[open_] + 1) & ((1 << self.bits) - 1)
        self.n_keys += len(key)

    def _encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Append the library's ids of new segments; where each one's begin, and their number."""
        count, buffers = [], []
        for at in range(0, len(parts), 4_000):
            for e in self.tokenizer.encode_batch_fast(parts[at : at + 4_000], add_special_tokens=False):
                ids = e.ids
                count.append(len(ids))
                buffers.append(ids)
        flat = np.fromiter(chain.from_iterable(buffers), np.uint32, sum(count))
        need = self.n_ids + len(flat)
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(need, len(self.ids)), np.uint32)])
        self.ids[self.n_ids : need] = flat
        count = np.array(count, np.int64)
        start = self.n_ids + np.cumsum(count) - count
        self.n_ids = need
        return start, count

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a large-string column, text after text, and where each text's begin (one more for the end)."""
        if self.keys is None or self.n_keys > 1 << (self.bits - 1) or self.n_ids > 8 << self.bits:
            self._clear()
        data, offsets = bytes_of(texts)
        first = np.zeros(len(data) + 1, bool)
        first[offsets[:-1]] = True
        if self.split and len(data) > 2:
            white = _white(data)
            edge = (data[1:-1] == 32) | (data[1:-1] == 10)
            edge &= ~white[:-2] & ~white[2:]
            inner = np.zeros(len(data) + 1, bool)
            inner[1 : len(data) - 1] = edge
            # What stands at either end of a text has no neighbour in it.
            inner[offsets[:-1]] = False
            inner[np.maximum(offsets[1:] - 1, 0)] = False
            first |= inner
        begin = np.flatnonzero(first[: len(data)])
        end = np.append(begin[1:], len(data)).astype(np.int64)
        doc = np.searchsorted(offsets[1:], begin, side="right")
        key = np.maximum(hash_spans(data, begin, end), np.uint64(1))
        size = (end - begin).astype(np.int32)
        place = self._find(key, size)
        start, count = self.starts[place], self.counts[place].astype(np.int64)
        lost = np.flatnonzero(place < 0)
        if len(lost):
            # Equal hashes of unlike lengths are told apart as in the table.
            _, one, back = np.unique(key[lost] ^ size[lost].astype(np.uint64), return_index=True, return_inverse=True)
            one = lost[one]
            raw = data.tobytes()
            new = self._encode([raw[a:b].decode() for a, b in zip(begin[one].tolist(), end[one].tolist(), strict=True)])
            start[lost], count[lost] = new[0][back], new[1][back]
            # The table takes what it has room for; it is emptied before the next batch.
            room = (3 << (self.bits - 2)) - self.n_keys
            short = size[one] <= LONGEST
            short &= np.cumsum(short) <= room
            self._insert(key[one][short], size[one][short], new[0][short], new[1][short])
        total = np.concatenate([[0], np.cumsum(count)])
        at = np.arange(total[-1]) + np.repeat(start - total[:-1], count)
        return self.ids[at], total[np.searchsorted(doc, np.arange(len(texts) + 1))]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian bytes."""
        ids, first = self.batch(pa.array(texts, pa.large_string()))
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def encoder(path: str) -> SegmentEncoder:
    """The worker's encoder of a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = SegmentEncoder(path)
    return _ENCODERS[path]


def file_digest(path: str) -> str:
    """Version of a tokenizer: SHA-256 of its file."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def as_ids(ids: bytes) -> np.ndarray:
    """Ids as an array."""
    return np.frombuffer(ids, "<u4")
