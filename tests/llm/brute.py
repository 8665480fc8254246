"""Plain versions of the operators' contracts, over Python lists."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")

STORY = """The river runs slowly past old houses and quiet green fields while children watch from a wooden bridge.
In summer people come down to the water with bread and cheese, sit under the willows and talk until evening.
Nobody remembers when the mill was built, but its wheel still turns, and the miller likes to show visitors
how corn becomes flour between two heavy stones that were cut long before his grandfather was born."""

#: (doc_id, text, lang, source): NULLs, empty texts, ties, repeated rows, a long text.
EDGE = [
    (1, "one two three four five\nsix", "en", "a"),
    (2, "", "en", "a"),
    (3, None, None, None),
    (4, "   \n\t ", "fr", "b"),
    (4, "   \n\t ", "fr", "b"),
    (5, "Ünï cödé ### 漢字 　 \x85 \x1c ok's <|endoftext|> can't", "xx", "b"),
    (5, "other text of the same id", "en", "b"),
    (None, "no id here", "en", None),
    (None, None, None, "c"),
    (7, "tick " * 400, "en", "c"),
    (8, "\n".join(["same line here"] * 3 + ["other line"]) + " " + STORY, "en", "c"),
    (9, " ".join(f"word{i % 977} thing{i % 31}" for i in range(30_000)), "en", "long"),
    (10, "😀" * 300, None, "b"),
]
DOCS = "doc_id long, text string, lang string, source string"


@lru_cache
def tokens(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def quality_counts(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    symbols = sum(c in "#*$%&|<>" for c in text)
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def mix_targets(sizes: dict) -> dict:
    names = sorted((x for x in sizes if x is not None), key=lambda x: [ord(c) for c in x])
    names += [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 3 * sizes[s] <= level * weight[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = float(3 * sizes[s])
            left -= 3 * sizes[s]
        open_ -= full
    return out


def repeats(texts: list[bytes], size: int = 200) -> list[list[bool]]:
    count = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - size + 1):
            if count[t[i : i + size]] > 1:
                gone[i : i + size] = [True] * size
        out.append(gone)
    return out


def shingles(text: str | None, n: int) -> frozenset:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    if not words:
        return frozenset()
    if len(words) < n:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def near_components(docs: list[tuple], n: int = 2, percent: int = 80) -> dict:
    sets = {d: shingles(t, n) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    owners = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            owners[x].append(d)
    for d, s in sets.items():
        for e in {o for x in s for o in owners[x] if o < d}:
            if 100 * len(s & sets[e]) >= percent * len(s | sets[e]):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return {d: (len(s), root(d)) for d, s in sets.items()}
