"""Ids of two tokenizers for the same texts, byte by byte, with a bounded table of known segments."""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cohortforge.llm.segments import _white
from cohortforge.llm.text import bytes_of

#: New segments that are encoded as one text.
TOGETHER = 64
_PAIRS: dict[tuple[str, str], TokenPair] = {}


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable bytes stand for themselves; the others, in order, are the characters from 256 on.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


class ByteLevel:
    """A byte-level BPE file of the tokenizers library; strings of special tokens are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True
        table = byte_characters()
        self.tokens = [b""] * self.library.get_vocab_size()
        for token, number in self.library.get_vocab().items():
            self.tokens[number] = bytes(table.get(c, 63) for c in token)
        rules = json.loads(self.library.to_str())
        split = rules["pre_tokenizer"] or {}
        #: Its pattern never joins characters across a lone blank or line feed between two others.
        self.cuts = rules["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True)
        self.cuts = self.cuts and not split.get("add_prefix_space")

    def encode(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(parts, add_special_tokens=False)]


class Pieces:
    """A sentencepiece model that puts a blank before each text."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        pieces = [p.piece for p in model.pieces]
        byte = [self.library.is_byte(n) for n in range(len(pieces))]
        self.tokens = [bytes([int(p[3:5], 16)]) if b else p.replace("▁", " ").encode() for p, b in zip(pieces, byte, strict=True)]
        rule = model.normalizer_spec
        inner = any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        #: No piece goes on over a blank or a line feed, and nothing is rewritten.
        self.cuts = rule.name == "identity" and rule.add_dummy_prefix and not rule.remove_extra_whitespaces and not inner
        self.blank = self.library.piece_to_id("▁")

    def encode(self, parts: list[str]) -> list[list[int]]:
        """Ids of texts that begin with the blank which the model would put there, or with a line feed."""
        found = self.library.encode([p[1:] if p[0] == " " else p for p in parts], num_threads=1)
        return [ids if p[0] == " " else ids[1:] for p, ids in zip(parts, found, strict=True)]


class TokenPair:
    """Ids of both tokenizers for texts with a blank before them."""

    def __init__(self, a_path: str, b_path: str, most: int = 200_000):
        self.sides = (ByteLevel(a_path), Pieces(b_path))
        self.sizes = [np.array([len(t) for t in side.tokens], np.int64) for side in self.sides]
        self.cuts = all(side.cuts for side in self.sides)
        self.most = most
        a, b = (len(side.tokens) for side in self.sides)
        self.bases = (0, 2 * a)
        #: Decimal ids with what follows them: ``,`` and, at the end of a group, ``|`` for A and ``;`` for B.
        self.decimal = pa.array(
            [f"{n}{c}" for size, ends in ((a, ",|"), (b, ",;")) for c in ends for n in range(size)], pa.large_string()
        )
        self.clear()

    def clear(self) -> None:
        """Forget the known segments."""
        self.known: dict[bytes, int] = {}
        self.ids = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.ends = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        self.right = np.zeros(0, bool)

    def _learn(self, parts: list[bytes]) -> None:
        """Encode new segments and keep their ids.

        Segments that may follow one another are encoded many to a text. Ids are dealt out to
        the segments by their bytes; if these aren't the segments', each one is encoded by itself.
        """
        size = np.array([len(p) for p in parts], np.int64)
        ends = np.cumsum(size)
        data = np.frombuffer(b"".join(parts), np.uint8)
        white = np.append(_white(data), True)
        apart = white[ends - 1] | white[ends - size + 1] | (size < 2) | (not self.cuts)
        # A text ends before and behind a segment that doesn't bear a neighbour, and after every TOGETHER ones.
        opens = apart | np.append(True, apart[:-1]) | (np.arange(len(parts)) % TOGETHER == 0)
        first = np.flatnonzero(opens)
        bounds = np.append(ends[first] - size[first], ends[-1]).tolist()
        blob = data.tobytes()
        texts = [blob[a:b].decode() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        sides = []
        for n, side in enumerate(self.sides):
            ids = np.fromiter(chain.from_iterable(side.encode(texts)), np.int64)
            token_ends = np.cumsum(self.sizes[n][ids])
            count = np.searchsorted(token_ends, ends, side="right")
            met = len(ids) and token_ends[-1] == len(data) and np.array_equal(token_ends[count - 1], ends)
            if not met or b"".join(map(side.tokens.__getitem__, ids.tolist())) != blob:
                self._learn_singly(parts)
                return
            sides.append((ids, count))
        self._keep(parts, sides, np.ones(len(parts), bool))

    def _learn_singly(self, parts: list[bytes]) -> None:
        """Encode each new segment by itself and tell those that a tokenizer doesn't give back."""
        texts, right, sides = [p.decode() for p in parts], np.ones(len(parts), bool), []
        for side in self.sides:
            found = side.encode(texts)
            right &= [b"".join([side.tokens[i] for i in ids]) == part for ids, part in zip(found, parts, strict=True)]
            sides.append((np.fromiter(chain.from_iterable(found), np.int64), np.cumsum([len(ids) for ids in found])))
        self._keep(parts, sides, right)

    def _keep(self, parts: list[bytes], sides: list, right: np.ndarray) -> None:
        for n, (ids, count) in enumerate(sides):
            self.ends[n] = np.concatenate([self.ends[n], self.ends[n][-1] + count])
            self.ids[n] = np.concatenate([self.ids[n], ids])
        self.known.update(zip(parts, range(len(self.known), len(self.known) + len(parts)), strict=True))
        self.right = np.concatenate([self.right, right])

    def segments(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Known segment of each place that both tokenizers begin a token at for sure, and its text.

        Segments are told by their bytes. Texts are null, or not empty.
        """
        blank, nothing = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
        data, offsets = bytes_of(pc.binary_join_element_wise(blank, texts, nothing))
        first = np.zeros(len(data), bool)
        first[offsets[:-1]] = True
        if self.cuts and len(data) > 2:
            white = _white(data)
            inner = (data[1:-1] == 32) | (data[1:-1] == 10)
            inner &= ~white[:-2] & ~white[2:]
            # The last byte of a text has no neighbour in it.
            inside = np.zeros(len(data), bool)
            inside[1:-1] = inner
            inside[offsets[1:] - 1] = False
            first |= inside
        begin = np.flatnonzero(first)
        bounds = pa.py_buffer(np.append(begin, len(data)).astype(np.int64))
        codes = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, bounds, pa.py_buffer(data)]).dictionary_encode()
        distinct = codes.dictionary.to_pylist()
        if len(self.known) + len(distinct) > self.most:
            self.clear()
        lost = [p for p in distinct if p not in self.known]
        for at in range(0, len(lost), 16_000):
            self._learn(lost[at : at + 16_000])
        number = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        doc = np.searchsorted(offsets[1:], begin, side="right")
        return number[codes.indices.to_numpy()], doc


def token_pair(a_path: str, b_path: str) -> TokenPair:
    """The worker's pair of tokenizers; the segments it has learnt are the caller's to clear."""
    if (a_path, b_path) not in _PAIRS:
        _PAIRS.clear()
        _PAIRS[a_path, b_path] = TokenPair(a_path, b_path)
    return _PAIRS[a_path, b_path]
