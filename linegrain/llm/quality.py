"""Quality rules from tokeniser fertility.

Every whole text is cut into words (runs of anything but ASCII white space).
A public byte-fallback vocabulary encodes the words, and three measures of the
text come out of that:

* ``chars_per_token``: letters and digits per piece, so that pieces spent on
  marks and symbols lower it; every code point beyond ASCII counts as a letter;
* ``byte_share``: share of pieces that stand for single bytes;
* ``token_entropy``: Shannon entropy in bits of its pieces, divided by the
  largest value that so many pieces can have.

A text is rejected outside the band of its language, or, where the language
is unknown, of the script that most of its letters belong to. The bands are
fixed parameters, so that a text's verdict does not depend on other texts.

Characters per token of a short text are uncertain: a few words, a number or an
id move them. So the least value is held against the mean plus ``MARGIN`` times
its standard error over the text's words, which falls with length. A text with
many symbols is held against the mean itself.

The base rules count on the same words: symbols, repeated lines, and words in
three-word windows that occur more than once.

NULL and empty texts have no words: all counts are 0 and they fail the base
rule. Equal rows get equal rows. Other columns of the input are kept apart
from the work and come back unchanged from :func:`keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linegrain.llm.common import SMALL_STEP_BYTES, Words, steps, text_bytes, vocabulary
from linegrain.llm.tokens import LONG, Runs

PIECES = "piece_bpe_32k.model"
LEAST_WORDS = 50
#: Percent of words that may lie in repeated windows.
MOST_REPEATED = 50

#: Standard errors by which the mean of a text must fall short of the least characters per token.
MARGIN = 3.0
#: Percent of symbols in the words of a text from which on it has no margin.
SYMBOL_PERCENT = 2

#: language or script: least and most characters per token, most byte share, least entropy.
BANDS = {
    "en": (1.8, 9.0, 0.25, 0.35),
    "de": (1.9, 9.0, 0.25, 0.35),
    "fr": (1.7, 9.0, 0.25, 0.35),
    "es": (1.7, 9.0, 0.25, 0.35),
    "latin": (1.4, 9.0, 0.35, 0.35),
    "cyrillic": (0.7, 9.0, 0.35, 0.35),
    "greek": (0.5, 9.0, 0.60, 0.35),
    "arabic": (0.5, 9.0, 0.60, 0.35),
    "hebrew": (0.5, 9.0, 0.60, 0.35),
    "devanagari": (0.3, 9.0, 0.80, 0.35),
    "kana": (0.4, 4.0, 0.80, 0.35),
    "han": (0.3, 4.0, 0.90, 0.35),
    "hangul": (0.3, 4.0, 0.95, 0.35),
    "other": (0.2, 9.0, 1.00, 0.35),
}

#: script: first and last code point of its letters, in the order in which ties go.
SCRIPTS = {
    "latin": (0x0041, 0x024F),
    "greek": (0x0370, 0x03FF),
    "cyrillic": (0x0400, 0x052F),
    "hebrew": (0x0590, 0x05FF),
    "arabic": (0x0600, 0x06FF),
    "devanagari": (0x0900, 0x097F),
    "kana": (0x3040, 0x30FF),
    "han": (0x4E00, 0x9FFF),
    "hangul": (0xAC00, 0xD7AF),
}

MEASURES = (
    "n_words long, word_chars long, n_letters long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_pieces long, n_byte_pieces long, letters_error double, token_entropy double, script string"
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: ASCII letters and digits, and the first byte of every longer code point.
_LETTER = np.array([chr(i).isalnum() if i < 128 else i >= 0xC0 for i in range(256)])


class _Pieces:
    """Piece ids of words by sentencepiece; words met before are not encoded again."""

    def __init__(self, path: str, keep: int = 300_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.IsByte(i) for i in range(self.model.GetPieceSize())])
        self.keep = keep
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.table = Runs()

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The piece ids of all words after each other, and how many each word has."""
        if len(self.known) > self.keep:
            self._forget()
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        new.sort(key=lambda w: len(w) > LONG)
        short = sum(len(w) <= LONG for w in new)
        self._learn(new[:short])
        kept = self.table.n, self.table.n_ids
        self._learn(new[short:])
        found = self.table.gather(np.array([self.known[w] for w in words], np.int64))
        self.table.n, self.table.n_ids = kept
        for w in new[short:]:
            del self.known[w]
        return found

    def _learn(self, new: list[bytes]) -> None:
        if not new:
            return
        found = self.model.encode([w.decode("utf-8", "replace") for w in new], num_threads=1)
        counts = np.array([len(x) for x in found], np.int64)
        self.known.update(zip(new, range(self.table.n, self.table.n + len(new)), strict=True))
        self.table.append(np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum())), counts)


def _by_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a 0/1 array over byte ranges."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated_words(words: Words) -> np.ndarray:
    """Per text, the words that lie in a three-word window met at least twice in it."""
    count = words.per_text
    at = np.flatnonzero(
        np.arange(len(words.hash)) + 2 < np.repeat(np.cumsum(count), count)
    )  # windows that end in their own text
    if not len(at):
        return np.zeros(len(count), np.int64)
    text, value = words.shingles(3)
    value = value[(count >= 3)[text]]
    order = np.lexsort((value, words.text[at]))
    t, v = words.text[at][order], value[order]
    same = (t[1:] == t[:-1]) & (v[1:] == v[:-1])
    twice = np.zeros(len(at), bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(len(words.hash), bool)
    hit = at[order[twice]]
    for i in range(3):
        covered[hit + i] = True
    return np.bincount(words.text[covered], minlength=len(count))


def _repeated_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    raw = data.tobytes()
    out = np.zeros(len(offsets) - 1, np.int64)
    for i in range(len(out)):
        lines = [x for x in raw[offsets[i] : offsets[i + 1]].split(b"\n") if x and not x.isspace()]
        out[i] = len(lines) - len(set(lines))
    return out


def _entropy(text: np.ndarray, piece: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Entropy of each text's pieces over the most that so many pieces allow; 1 for fewer than two."""
    pair, times = np.unique(text * 100_000 + piece, return_counts=True)
    owner = pair // 100_000
    share = times / n[owner]
    bits = -np.bincount(owner, weights=share * np.log2(share), minlength=len(n))
    return np.where(n > 1, bits / np.log2(np.maximum(n, 2)), 1.0)


def _letters_error(text: np.ndarray, letters: np.ndarray, pieces: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Standard error of each text's letters per piece, as a ratio of sums over its words."""
    total = lambda v: np.bincount(text, weights=v, minlength=len(n))
    ratio = total(letters) / np.maximum(n, 1)
    rest = letters - ratio[text] * pieces
    return np.sqrt(total(rest * rest)) / np.maximum(n, 1)


def _scripts(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    raw = data.tobytes()
    names = list(SCRIPTS)
    out = []
    for i in range(len(offsets) - 1):
        part = raw[offsets[i] : offsets[i + 1]]
        if part.isascii():
            out.append("latin" if any(x in part for x in (b"a", b"e", b"i", b"o", b"u")) or part.upper() != part.lower() else "other")
            continue
        points = np.frombuffer(part.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        shares = [int(((points >= a) & (points <= b)).sum()) for a, b in SCRIPTS.values()]
        out.append(names[int(np.argmax(shares))] if max(shares) else "other")
    return out


def _measure(batches: Iterator[pa.RecordBatch], path: str, with_text: bool) -> Iterator[pa.RecordBatch]:
    pieces = _Pieces(path)
    for part in steps(batches, "_text", SMALL_STEP_BYTES):
        data, offsets = text_bytes(part.column("_text"))
        words = Words(data, offsets)
        raw = data.tobytes()
        _, at, which = np.unique(words.hash, return_index=True, return_inverse=True)
        flat, size = pieces.encode([raw[words.start[i] : words.end[i]] for i in at])
        begin = np.cumsum(size) - size
        times = size[which]
        place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        piece = flat[np.repeat(begin[which], times) + place].astype(np.int64)
        owner = np.repeat(words.text, times)
        n = np.bincount(owner, minlength=len(offsets) - 1)
        lead = (data & 0xC0) != 0x80
        letters = np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])
        chars = np.bincount(words.text, weights=letters[words.end] - letters[words.start], minlength=len(n))
        in_words = np.concatenate([[0], np.cumsum(_LETTER[data], dtype=np.int64)])
        columns = {
            "n_words": words.per_text,
            "word_chars": chars.astype(np.int64),
            "n_letters": _by_text(_LETTER[data], offsets),
            "n_symbols": _by_text(_SYMBOL[data], offsets),
            "n_dup_lines": _repeated_lines(data, offsets),
            "n_repeat_words": _repeated_words(words),
            "n_pieces": n,
            "n_byte_pieces": np.bincount(owner[pieces.is_byte[piece]], minlength=len(n)),
            "letters_error": _letters_error(words.text, in_words[words.end] - in_words[words.start], times, n),
            "token_entropy": _entropy(owner, piece, n),
            "script": _scripts(data, offsets),
        }
        arrays = [part.column(0), *(pa.array(v) for v in columns.values()), *[part.column("_text")] * with_text]
        yield pa.RecordBatch.from_arrays(arrays, names=["_row", *columns, *["_text"] * with_text])


def measure(docs: DataFrame, text: str = "text", carry: list[str] | None = None, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs`` with the measures of its whole text, the columns to ``carry`` and, if wanted, ``_text``."""
    carried = F.struct(*[F.col(c) for c in (docs.columns if carry is None else carry)])
    slim = docs.select(carried.alias("_row"), F.col(text).alias("_text"))
    schema = f"_row {slim.schema['_row'].dataType.simpleString()}, {MEASURES}" + ", _text string" * with_text
    path = vocabulary(PIECES)
    return slim.mapInArrow(lambda batches: _measure(batches, path, with_text), schema)


def _band(language: Column, bands: dict, which: int) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in bands.items() for x in (k, float(v[which]))])
    return F.coalesce(table[language], table[F.col("script")], table[F.lit("other")])


def judge(measured: DataFrame, language: Column, bands: dict | None = None) -> DataFrame:
    """Adds the measures' ratios, ``base_failed`` and ``kept``."""
    bands = BANDS if bands is None else bands
    base = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )
    pieces = F.greatest(F.col("n_pieces"), F.lit(1))
    ratios = measured.withColumns(
        {"chars_per_token": F.col("n_letters") / pieces, "byte_share": F.col("n_byte_pieces") / pieces}
    )
    few = 100 * F.col("n_symbols") < SYMBOL_PERCENT * F.col("word_chars")
    margin = F.when(few, MARGIN * F.col("letters_error")).otherwise(0.0)
    inside = (
        (F.col("chars_per_token") + margin >= _band(language, bands, 0))
        & (F.col("chars_per_token") <= _band(language, bands, 1))
        & (F.col("byte_share") <= _band(language, bands, 2))
        & (F.col("token_entropy") >= _band(language, bands, 3))
    )
    return ratios.withColumns({"base_failed": base, "kept": ~base & inside})


def keep_good(docs: DataFrame, text: str = "text", language: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``."""
    # The text goes to Python and comes back once, beside the other columns.
    measured = measure(docs, text, [c for c in docs.columns if c != text], with_text=True)
    judged = judge(measured, F.col(f"_row.{language}"))
    return judged.where("kept").select(*[F.col("_text" if c == text else f"_row.{c}").alias(c) for c in docs.columns])
