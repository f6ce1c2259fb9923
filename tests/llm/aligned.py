"""Plain Python form of the alignment of two tokenizers."""

from __future__ import annotations

import hashlib
from collections import Counter


def token_bytes(a_path: str, b_path: str):
    """Functions that give ``(id, bytes)`` of each token of a text."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = dict(zip(map(chr, plain), plain, strict=True))
    for x in range(256):
        if x not in plain:
            byte[chr(256 + len(byte) - len(plain))] = x

    def of_a(text: str):
        return [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]

    def of_b(text: str):
        out = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            out.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        return out

    return of_a, of_b


def groups(text: str | None, of_a, of_b) -> list[tuple[list[int], list[int]]]:
    if not text:
        return []
    a, b = of_a(text), of_b(text)
    whole = (" " + text).encode()
    if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return []
    ends = []
    for tokens in (a, b):
        at, own = 0, set()
        for _, x in tokens:
            at += len(x)
            own.add(at)
        ends.append(own)
    both, out = ends[0] & ends[1], []
    sides = []
    for tokens in (a, b):
        at, rows = 0, [[]]
        for i, x in tokens:
            at += len(x)
            rows[-1].append(i)
            if at in both:
                rows.append([])
        sides.append(rows[:-1])
    out = list(zip(*sides, strict=True))
    return out


def aligned(docs: list[tuple], a_path: str, b_path: str) -> list[tuple]:
    """Rows ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    of_a, of_b = token_bytes(a_path, b_path)
    found = [(d, groups(t, of_a, of_b)) for d, t in docs]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for _, g in found]
    counts = Counter(p for c in links for p in c)
    best: dict[int, int] = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    rows = []
    for (d, g), c in zip(found, links, strict=True):
        line = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        rows.append(
            (
                d,
                sum(len(a) for a, _ in g),
                sum(len(b) for _, b in g),
                len(g),
                sum(c.values()),
                sum(n for p, n in c.items() if counts[p] == best[p[0]]),
                sum(n * counts[p] for p, n in c.items()),
                hashlib.sha256(line.encode()).hexdigest() if g else "",
            )
        )
    return rows
