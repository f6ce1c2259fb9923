"""Hashed byte n-grams and style figures of whole texts, counted in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortforge.llm.text import Words

STYLE = 12


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def gram_counts(texts: pa.Array, buckets: int, sizes: tuple[int, ...]) -> np.ndarray:
    """Share of each hash bucket among the byte n-grams of each text (a row per text).

    ASCII letters are lower-cased and runs of other bytes kept, so word ends count as
    part of an n-gram. A text too short for any n-gram is a row of zeros.
    """
    words = Words(texts, lower=True)
    data = words.data.astype(np.uint32)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    total = np.zeros(len(texts) * buckets, np.float32)
    shift = np.uint32(32 - buckets.bit_length() + 1)
    for size in sizes:
        count = max(0, len(data) - size + 1)
        value = np.zeros(count, np.uint32)
        for step in range(size):
            value = value * np.uint32(257) + data[step : step + count]
        value = ((value + np.uint32(size)) * np.uint32(2654435761)) >> shift
        whole = doc[:count] == doc[size - 1 : size - 1 + count]
        total += np.bincount((doc[:count] * buckets + value)[whole], minlength=len(total))
    total = total.reshape(len(texts), buckets)
    return total / np.maximum(total.sum(axis=1, keepdims=True), 1)


def style(texts: pa.Array) -> np.ndarray:
    """Twelve figures of each text that do not depend on its language."""
    words = Words(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    sizes = np.diff(offsets)
    count = len(texts)
    doc = np.repeat(np.arange(count), sizes)
    data = words.data
    n_bytes = np.maximum(sizes, 1)

    def share(flags: np.ndarray) -> np.ndarray:
        return np.bincount(doc, flags, count) / n_bytes

    upper = (data >= 65) & (data <= 90)
    digit = (data >= 48) & (data <= 57)
    letter = upper | ((data >= 97) & (data <= 122)) | (data >= 128)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    stop = (data == 44) | (data == 46)
    n_words = np.diff(words.first)
    some = np.maximum(n_words, 1)
    length = words.end - words.start
    order = np.lexsort((words.hash, words.doc))
    sorted_hash, sorted_doc = words.hash[order], words.doc[order]
    new = np.ones(len(order), bool)
    new[1:] = (sorted_hash[1:] != sorted_hash[:-1]) | (sorted_doc[1:] != sorted_doc[:-1])
    again = np.zeros(len(words.hash), bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    per_word = lambda values: np.bincount(words.doc, values, count) / some
    return np.column_stack(
        [
            share(upper),
            share(digit),
            share(~(letter | digit | blank | stop)),
            share(stop),
            share(data == 10),
            per_word(length) / 10,
            np.bincount(sorted_doc, new, count) / some,
            per_word(again),
            per_word(length > 20),
            per_word(length <= 2),
            np.log1p(n_words) / 10,
            (n_words < 20).astype(float),
        ]
    ).astype(np.float32)
