"""Small awkward tables and plain Python forms of the operators."""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, score double"

PASSAGE = " ".join(f"w{i * 7 % 53}x" for i in range(60))
BASE = " ".join(f"t{i * i % 101}q" for i in range(120))


def near(text: str, places: list[int]) -> str:
    """``text`` with the words at ``places`` changed."""
    words = text.split(" ")
    for place in places:
        words[place] = f"changed{place}"
    return " ".join(words)


def rows() -> list[tuple]:
    """Nulls, empties, ties, copies, near copies, a long text and awkward characters."""
    texts = {
        0: BASE,
        1: BASE,
        2: near(BASE, [40]),
        3: near(BASE, [40, 90]),
        4: "intro words " + PASSAGE + " and an end",
        5: "other opening\n" + PASSAGE + "\nother end of it",
        6: None,
        7: "",
        8: "   \t\n ",
        9: "two words",
        10: "two words",
        11: "ONE\n\ntwo  three\r\n<|endoftext|> x́eéÅ \x1c\x85 y",
        12: "a b c\nd e f\ng h i\nlast line of this one",
        13: "x y z\na b c\nd e f\nmore",
        14: "a b c\nd e f\na b c\nd e f",
        15: "123 456 -- !!",
        16: " ".join(["be"] * 80),
        17: " ".join(f"v{i % 977}" for i in range(6000)),
        18: "one line that has more than eight words in it today\nb",
        19: "c\none line that has more than eight words in it today",
    }
    out = [(i, t, "en" if i % 2 else None, "s", None if i % 3 else 7, 5, 0.1) for i, t in texts.items()]
    out.append((1, BASE, "en", "s", 1, 1, 0.5))  # a repeated row
    out.append((None, BASE, None, None, None, None, None))
    return out


def words(text: str | None, lower: bool = False) -> list[str]:
    text = text or ""
    if lower:
        text = re.sub("[A-Z]+", lambda m: m[0].lower(), text)
    return WORD.findall(text)


def substring_removed(docs: list[tuple[int, str | None]], window: int = 13) -> dict[int, list[str]]:
    """Kept words of each id."""
    first: dict[tuple, int] = {}
    for doc_id, text in docs:
        w = words(text)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, doc_id), doc_id)
    kept = {}
    for doc_id, text in docs:
        w = words(text)
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < doc_id:
                gone |= set(range(s, s + window))
        kept[doc_id] = [x for i, x in enumerate(w) if i not in gone]
    return kept


def shingles(text: str | None) -> set[tuple]:
    w = words(text, lower=True)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_components(docs: list[tuple[int, str | None]], percent: int = 85) -> dict[int, int]:
    """Smallest reachable id of each id, by comparing all pairs that share a shingle."""
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    pairs = {p for ids in where.values() for p in combinations(sorted(ids), 2)}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            ra, rb = sorted((root(a), root(b)))
            parent[rb] = ra
    return {d: root(d) for d in sets}


def line_kept(docs: list[tuple[int, str]], min_lines: int = 2, min_words: int = 8) -> dict[int, list[str]]:
    """Kept lines of each id."""
    seen, gone = set(), defaultdict(set)
    for doc_id, text in sorted(docs):
        lines = text.split("\n")
        for i in range(len(lines)):
            for size in (1, min_lines):
                run = tuple(lines[i : i + size])
                if len(run) < size:
                    continue
                if run in seen and (size > 1 or len(words(run[0])) >= min_words):
                    gone[doc_id] |= set(range(i, i + size))
                seen.add(run)
    return {d: [x for i, x in enumerate(t.split("\n")) if i not in gone[d]] for d, t in docs}


def leaks(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]]) -> set[tuple[int, int]]:
    """Pairs of a document and an item, by trying every alignment."""
    found = set()
    for item_id, item in items:
        v = WORD.findall((item or "").lower())
        if len(v) < 8:
            continue
        needed = 11 if len(v) >= 13 else len(v)
        for doc_id, text in docs:
            w = WORD.findall((text or "").lower())
            for shift in range(-len(v), len(w) + 1):
                equal = [0 <= shift + i < len(w) and w[shift + i] == x for i, x in enumerate(v)]
                if max(sum(equal[s : s + 13]) for s in range(max(1, len(v) - 12))) >= needed:
                    found.add((doc_id, item_id))
                    break
    return found
