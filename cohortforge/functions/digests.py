"""MD5 digests of many numbered texts at once, for tasks that make a digest for each patient and draw."""

from __future__ import annotations

import hashlib
import math

import numpy as np

#: Texts that are digested side by side.
AT_ONCE = 32_768
_ADD = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURN = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Bytes of a text that fits one block.
_ONE_BLOCK = 55


def md5_heads(prefixes: list[bytes], start: int, stop: int) -> np.ndarray:
    """First eight bytes, as a number, of the MD5 digest of each prefix (row) and each number from ``start`` up to ``stop`` (column).

    A text is the prefix and the number's decimal digits.
    """
    heads = np.empty((len(prefixes), stop - start), np.uint64)
    lengths = np.array([len(p) for p in prefixes])
    while start < stop:
        digits = len(str(start))
        upto = min(stop, 10**digits, start + AT_ONCE)
        own = heads[:, heads.shape[1] - (stop - start) :][:, : upto - start]
        for length in np.unique(lengths):
            rows = np.flatnonzero(lengths == length)
            if length + digits > _ONE_BLOCK:
                own[rows] = [[_head(prefixes[r] + b"%d" % number) for number in range(start, upto)] for r in rows]
                continue
            tail = _words(np.arange(start, upto), int(length), digits)
            step = max(1, AT_ONCE // (upto - start))
            for some in (rows[at : at + step] for at in range(0, len(rows), step)):
                front = np.frombuffer(b"".join(prefixes[r].ljust(64, b"\0") for r in some), "<u4").reshape(-1, 16)
                a, b = _digest(front, tail, (len(some), upto - start))
                own[some] = a.byteswap().astype(np.uint64) << np.uint64(32) | b.byteswap()
        start = upto
    return heads


def _head(text: bytes) -> int:
    return int.from_bytes(hashlib.md5(text).digest()[:8], "big")


def _words(numbers: np.ndarray, length: int, digits: int) -> np.ndarray:
    """The 16 words (rows) of each text without its prefix."""
    block = np.zeros((len(numbers), 64), np.uint8)
    for place in range(digits):
        block[:, length + place] = numbers // 10 ** (digits - 1 - place) % 10 + ord("0")
    block[:, length + digits] = 0x80
    block[:, 56:58] = np.frombuffer((8 * (length + digits)).to_bytes(2, "little"), np.uint8)
    return np.ascontiguousarray(block.view("<u4").T)


def _digest(front: np.ndarray, tail: np.ndarray, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """First two words of the digests of one-block texts, whose words are those of ``front`` (prefixes by words) and ``tail`` together."""
    words = []
    for i in range(16):
        once = (tail[i] == tail[i, 0]).all()
        words.append(front[:, i : i + 1] | (tail[i, :1] if once else tail[i]))
    a, b, c, d = (np.full(shape, x, np.uint32) for x in _START)
    mixed, turned = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=mixed)
            mixed &= b
            mixed ^= d
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=mixed)
            mixed &= d
            mixed ^= c
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=mixed)
            mixed ^= d
        else:
            g = 7 * i % 16
            np.bitwise_not(d, out=mixed)
            mixed |= b
            mixed ^= c
        mixed += a
        if words[g].shape[1] == 1:
            mixed += words[g] + np.uint32(_ADD[i])
        else:
            mixed += words[g]
            mixed += np.uint32(_ADD[i])
        np.left_shift(mixed, np.uint32(_TURN[i]), out=turned)
        mixed >>= np.uint32(32 - _TURN[i])
        mixed |= turned
        np.add(mixed, b, out=a)
        a, b, c, d = d, a, b, c
    return a + np.uint32(_START[0]), b + np.uint32(_START[1])
