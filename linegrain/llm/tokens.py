"""Token ids of whole texts by public vocabularies of the tokenizers library.

Both vocabularies cut a text at white space before they merge, and then into
runs of letters, digits and signs. Here a text is cut into those runs where
that is certain: inside chunks of Latin letters, ASCII digits and ASCII signs
without apostrophes and bars. Any other chunk between white space stays whole.
Each distinct part is encoded only once per Python worker: runs by the merges
of the vocabulary alone, other chunks by the whole library, many in a call.
Many texts are taken at a time, and ids are gathered from flat arrays.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain, repeat
from operator import attrgetter

import numpy as np

from linegrain.llm.common import vocabulary

#: White space of the Unicode standard, which is what the vocabularies' patterns go by.
WHITE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters that are composed already, are lower-cased one by one, and are letters in every version of Unicode.
_LATIN = "A-Za-zÀ-ÖØ-öø-įıĳ-ſ"
#: ASCII signs and controls that are neither white space nor apostrophe nor bar.
_SIGNS = r"\x00-\x08\x0e-\x1b!-&(-/:-@\[-`{}~"
_ODD = f"[^{WHITE}{_LATIN}0-9{_SIGNS}]"
_REST = f"[{_LATIN}0-9{_SIGNS}]*+{_ODD}[^{WHITE}]*"
_CUTS = {
    # White space is dropped, digits stand one by one.
    "word_bpe_49k.json": (f"(?<![^{WHITE}]){_REST}|", f"[{_LATIN}]+|[0-9]|[{_SIGNS}]+"),
    # A space belongs to what is behind it; other white space stands alone.
    "byte_bpe_50k.json": (
        f"(?: |(?<![^{WHITE}])){_REST}|",
        f" ?[{_LATIN}]+| ?[0-9]+| ?[{_SIGNS}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+",
    ),
}
_HAS_ODD = re.compile(_ODD).search
_ODD_ASCII = "'|\x1c\x1d\x1e\x1f\x7f"


def _is_odd(text: str) -> bool:
    """Whether a text has a chunk that must stay whole."""
    if text.isascii():
        return any(c in text for c in _ODD_ASCII)
    return _HAS_ODD(text) is not None


_LOWER = {"word_bpe_49k.json"}
_RUN = re.compile(f" ?(?:[{_LATIN}]+|[0-9]+|[{_SIGNS}]+)").fullmatch
#: A special token of both vocabularies, which ends whatever stands before it.
_STOP = "<|endoftext|>"
#: Parts longer than this are encoded but not remembered; new chunks that go to the library as one text.
LONG, _TOGETHER = 64, 512
_ID = attrgetter("id")


class Runs:
    """Runs of ids after each other, by number."""

    def __init__(self):
        self.ids = np.zeros(1 << 12, np.uint32)
        self.first = np.zeros(1 << 10, np.int64)
        self.count = np.zeros(1 << 10, np.int64)
        self.n = self.n_ids = 0

    def append(self, ids: np.ndarray, counts: np.ndarray) -> None:
        self.ids = self._room(self.ids, self.n_ids + len(ids))
        self.first = self._room(self.first, self.n + len(counts))
        self.count = self._room(self.count, self.n + len(counts))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.first[self.n : self.n + len(counts)] = self.n_ids + np.cumsum(counts) - counts
        self.count[self.n : self.n + len(counts)] = counts
        self.n += len(counts)
        self.n_ids += len(ids)

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n - len(a), len(a)), a.dtype)])

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the runs, and how many each has."""
        count = self.count[numbers]
        shift = self.first[numbers] - (np.cumsum(count) - count)
        return self.ids[np.repeat(shift, count) + np.arange(int(count.sum()))], count


class Encoder:
    """Ids of texts, ``add_special_tokens=False``; remembers the parts that it has met."""

    def __init__(self, name: str, keep: int = 600_000, path: str | None = None):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path or vocabulary(name))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.stop = self.tokenizer.token_to_id(_STOP)
        odd, runs = _CUTS[name]
        self.runs, self.parts, self.lower = re.compile(runs).findall, re.compile(odd + runs).findall, name in _LOWER
        self.merge = self.tokenizer.model.tokenize
        level = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.shown = {i: level(chr(i))[0][0] for i in range(0x180)}
        self.keep = keep
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table = Runs()

    def encode(self, text: str) -> np.ndarray:
        """The ids of one text as unsigned 32-bit integers."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts after each other, and how many each text has."""
        if len(self.known) > self.keep:
            self._forget()
        parts = [(self.parts if _is_odd(t) else self.runs)(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(parts))
        numbers = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        at = np.flatnonzero(numbers < 0)
        long: list[str] = []
        if len(at):
            unknown = [flat[i] for i in at.tolist()]
            new = list(dict.fromkeys(unknown))
            long = [x for x in new if len(x) > LONG]
            self._learn([x for x in new if len(x) <= LONG] if long else new)
            kept = self.table.n, self.table.n_ids
            self._learn(long)
            numbers[at] = [self.known[x] for x in unknown]
        ids, count = self.table.gather(numbers)
        if long:
            self.table.n, self.table.n_ids = kept
            for x in long:
                del self.known[x]
        ends = np.concatenate([[0], np.cumsum(count)])
        stops = np.cumsum([len(p) for p in parts], dtype=np.int64)
        return ids, np.diff(ends[stops], prepend=0) if len(texts) else np.zeros(0, np.int64)

    def _learn(self, new: list[str]) -> None:
        runs = [x for x in new if _RUN(x)]
        shown, merge = self.shown, self.merge
        found = [merge((x.lower() if self.lower else x).translate(shown)) for x in runs]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        self._keep(runs, np.fromiter(map(_ID, chain.from_iterable(found)), np.uint32, int(counts.sum())), counts)
        if len(runs) < len(new):
            self._learn_chunks([x for x in new if x not in self.known])

    def _learn_chunks(self, new: list[str]) -> None:
        """Short chunks go to the library together, with a special token between them."""
        plain = [x for x in new if len(x) <= LONG and "<|" not in x]
        groups = [plain[i : i + _TOGETHER] for i in range(0, len(plain), _TOGETHER)]
        for group, found in zip(groups, self._library([_STOP.join(g) for g in groups]), strict=True):
            at = np.flatnonzero(found == self.stop)
            counts = np.diff(np.concatenate([[-1], at, [len(found)]])) - 1
            self._keep(group, found[found != self.stop], counts)
        odd = [x for x in new if x not in self.known]
        for x, found in zip(odd, self._library(odd), strict=True):
            self._keep([x], found, np.array([len(found)]))

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, chunks: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        self.known.update(zip(chunks, range(self.table.n, self.table.n + len(chunks)), strict=True))
        self.table.append(ids, counts)


@lru_cache(maxsize=2)
def encoder(name: str, path: str | None = None, keep: int = 600_000) -> Encoder:
    """The encoder of this Python worker, which keeps what it has learned from one task to the next."""
    return Encoder(name, keep, path)


def with_ends(ids: np.ndarray, counts: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with ``end`` behind every text."""
    if end is None:
        return ids, counts
    out = np.full(len(ids) + len(counts), end, ids.dtype)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
    return out, counts + 1
