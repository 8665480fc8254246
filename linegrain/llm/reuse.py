"""BPE encoding and decoding with content-defined chunks that documents share.

A rolling hash over the bytes of a text decides where its chunks end, so equal
passages give equal chunks wherever they stand. A chunk that occurs at two
places or more is shared: it is encoded once, in the text that comes first by
key, and its ids are joined to all places that have it. All else of a text is
encoded where it stands.

A chunk begins and ends anywhere, even inside a word, so its outer ids may be
wrong in place. White space ends every token of this vocabulary, hence joins
are repaired by words: what lies between the whole words of two shared chunks
is encoded afresh, with a word of each chunk on either side, and the ids of
those words must agree with the ids that the chunk brought along. Where they do
not, twice as many words are taken, until they agree or nothing of the chunk is left.

Texts are known by digest: equal texts are encoded once, and a hot text leaves
each task that reads it once. Hot chunks are joined as a skewed join. Nothing is capped: a chunk is as long as the hash makes it.

NULL and empty texts have no ids and decode to the empty string. Rows with
equal or NULL doc_id are documents of their own. An empty table gives no rows.
Further columns, of whatever name, are not read. A text is held whole by the
task that encodes it; its rolling hash is taken in blocks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linegrain.llm.common import STEP_BYTES, pinned, steps
from linegrain.llm.tokens import WHITE, Encoder, encoder

VOCABULARY = "word_bpe_49k.json"
#: Bytes that the rolling hash sees, and bits of it that are zero at the end of a chunk (about 1 kB).
WINDOW, BITS = 16, 10
#: Shorter chunks are not worth joining.
LEAST = 128
#: Parts that a worker remembers, some 400 MB; two workers and the JVM share an executor.
KEEP = 250_000
_BLOCK = 1 << 20
_GEAR = np.random.default_rng(4_711).integers(0, 1 << 32, 256, dtype=np.uint32)
_SPACE = re.compile(f"[{WHITE}]+")

REFS = "hash binary, key binary, start int, size int"
RESULT = "key binary, n_tokens long, ids_digest binary, decoded_digest binary"
WHOLE = RESULT + ", ids array<int>, decoded string"
PACKED = "_key binary, _packed binary"


def cut_points(data: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Ends of all chunks of a text's bytes, the last byte included; never inside a character."""
    found = []
    for begin in range(0, len(data), _BLOCK):
        from_byte = max(0, begin - WINDOW + 1)
        rolled = _GEAR[data[from_byte : begin + _BLOCK]]
        width = 1
        while width < WINDOW:
            rolled[width:] += rolled[:-width] << np.uint32(width)
            width *= 2
        ends = np.flatnonzero(rolled[begin - from_byte :] >> np.uint32(32 - bits) == 0) + begin + 1
        found.append(ends)
    ends = np.concatenate(found) if found else np.zeros(0, np.int64)
    while True:
        inside = ends < len(data)
        inside[inside] = (data[ends[inside]] & 0xC0) == 0x80
        if not inside.any():
            break
        ends = ends + inside
    return np.union1d(ends, [len(data)]) if len(data) else ends


def _cuts(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()
    for part in steps(batches, "_text"):
        columns: tuple[list, list, list, list] = [], [], [], []
        for key, text in zip(part.column("_key").to_pylist(), part.column("_text").to_pylist(), strict=True):
            if key in seen:
                continue
            seen.add(key)
            raw = text.encode()
            ends = cut_points(np.frombuffer(raw, np.uint8), bits)
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False):
                if b - a >= LEAST:
                    columns[0].append(hashlib.blake2b(raw[a:b], digest_size=16).digest())
                    columns[1].append(key)
                    columns[2].append(a)
                    columns[3].append(b - a)
        kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["hash", "key", "start", "size"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as zstd frames behind their size in eight bytes, which a shuffle holds in less room than its own compression."""
    codec = pa.Codec("zstd", 1)
    for part in steps(batches, "_text"):
        raws = [x.encode() for x in part.column("_text").to_pylist()]
        cells = [len(x).to_bytes(8, "little") + codec.compress(x, asbytes=True) for x in raws]
        yield pa.RecordBatch.from_arrays([part.column("_key"), pa.array(cells, pa.binary())], names=["_key", "_packed"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with ``_text`` in place of its frames, some STEP_BYTES at a time."""
    codec = pa.Codec("zstd")
    for batch in batches:
        cells = batch.column("_packed").to_pylist()
        sizes = np.array([int.from_bytes(x[:8], "little") for x in cells], np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < len(cells):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + STEP_BYTES, "right")))
            texts = [
                codec.decompress(c[8:], n, asbytes=True).decode() if n else "" for c, n in zip(cells[start:stop], sizes[start:stop].tolist(), strict=True)
            ]
            part = batch.slice(start, stop - start)
            yield part.set_column(part.schema.get_field_index("_packed"), "_text", pa.array(texts, pa.string()))
            start = stop


def _encode_homes(batches: Iterator[pa.RecordBatch], name: str, path: str | None) -> Iterator[pa.RecordBatch]:
    library = encoder(name, path, KEEP)
    for part in _unpacked(batches):
        hashes, chunks = [], []
        for text, homes in zip(part.column("_text").to_pylist(), part.column("homes").to_pylist(), strict=True):
            raw = text.encode()
            for h in homes:
                hashes.append(h["hash"])
                chunks.append(raw[h["start"] : h["start"] + h["size"]].decode())
        ids, counts = library.encode_many(chunks)
        ends = np.cumsum(counts)
        cells = [ids[b - n : b].astype("<u4").tobytes() for b, n in zip(ends.tolist(), counts.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(cells, pa.binary())], names=["hash", "ids"])


class _Chunk:
    """The whole words of a shared chunk in its place, and the ids that came with it."""

    def __init__(self, raw: bytes, start: int, size: int, ids: np.ndarray, library: Encoder):
        text = raw[start : start + size].decode()
        gaps = [m.span() for m in _SPACE.finditer(text)]
        # words[i] is text[a:b]; what is before the first and behind the last white space may be parts of words
        self.words = [(a[1], b[0]) for a, b in zip(gaps, gaps[1:], strict=False)]
        self.text = text
        if self.words:
            self.at = start + len(text[: self.words[0][0]].encode())
            self.end = start + len(text[: self.words[-1][1]].encode())
            head, tail = library.encode_many([text[: gaps[0][0]], text[gaps[-1][1] :]])[1].tolist()
            self.ids = ids[head : len(ids) - tail]

    def lap(self, words: int, last: bool) -> str | None:
        """The text of the first or last so many words; None when less than a word would be left between both."""
        if 2 * words >= len(self.words):
            return None
        if last:
            return self.text[self.words[-words][0] : self.words[-1][1]]
        return self.text[self.words[0][0] : self.words[words - 1][1]]


def joined(texts: list[str], parts: list[list[tuple[int, int, np.ndarray]]], library: Encoder) -> list[np.ndarray]:
    """The ids of each text, given ids of some chunks (start, size, ids) of its bytes."""
    raws = [t.encode() for t in texts]
    chunks = []
    for raw, known in zip(raws, parts, strict=True):
        own, end = [], 0
        for start, size, ids in sorted(known, key=lambda p: p[0]):
            if start >= end:  # a chunk that came twice is taken once
                chunk = _Chunk(raw, start, size, ids, library)
                end = start + size
                if chunk.lap(1, True) is not None:
                    own.append(chunk)
        chunks.append(own)
    laps = [{id(c): 1 for c in own} for own in chunks]
    done: list[np.ndarray | None] = [None] * len(texts)
    todo = list(range(len(texts)))
    while todo:
        windows, around = [], []
        for t in todo:
            raw, own, lap = raws[t], chunks[t], laps[t]
            bounds = [None, *own, None]
            for left, right in zip(bounds, bounds[1:], strict=False):
                before = left.lap(lap[id(left)], True) if left else ""
                after = right.lap(lap[id(right)], False) if right else ""
                middle = raw[left.end if left else 0 : right.at if right else len(raw)].decode()
                windows.append(before + middle + after)
                around += [before, after]
        found = np.split(*_runs(library.encode_many(windows)))
        sides = np.split(*_runs(library.encode_many(around)))
        at, again = 0, []
        for t in todo:
            own, lap = chunks[t], laps[t]
            pieces, wrong, cut = [], set(), 0
            for k in range(len(own) + 1):
                ids, n_before, n_after = found[at], len(sides[2 * at]), len(sides[2 * at + 1])
                at += 1
                if k:
                    left = own[k - 1]
                    if not np.array_equal(ids[:n_before], left.ids[len(left.ids) - n_before :]):
                        wrong.add(id(left))
                    pieces.append(left.ids[cut : len(left.ids) - n_before])
                if k < len(own):
                    if not np.array_equal(ids[len(ids) - n_after :], own[k].ids[:n_after]):
                        wrong.add(id(own[k]))
                    cut = n_after
                pieces.append(ids)
            if wrong:
                again.append(t)
                for c in own:
                    if id(c) in wrong:
                        lap[id(c)] *= 2
                chunks[t] = [c for c in own if c.lap(lap[id(c)], True) is not None]
            else:
                done[t] = np.concatenate(pieces)
        todo = again
    return done


def _runs(coded: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    ids, counts = coded
    return ids, np.cumsum(counts)[:-1]


def _assemble(batches: Iterator[pa.RecordBatch], name: str, path: str | None, whole: bool) -> Iterator[pa.RecordBatch]:
    library = encoder(name, path, KEEP)
    numbers = [str(i) for i in range(library.tokenizer.get_vocab_size())]
    for part in _unpacked(batches):
        keys, texts = part.column("_key").to_pylist(), part.column("_text").to_pylist()
        known = [
            [(c["start"], c["size"], np.frombuffer(c["ids"], "<u4")) for c in chunks or []] for chunks in part.column("chunks").to_pylist()
        ]
        ids = [x.tolist() for x in joined(texts, known, library)]
        decoded = library.tokenizer.decode_batch(ids, skip_special_tokens=False)
        columns = [
            pa.array(keys, pa.binary()), pa.array([len(x) for x in ids], pa.int64()),
            pa.array([_sha(" ".join([numbers[i] for i in x])) for x in ids], pa.binary()),
            pa.array([_sha(x) for x in decoded], pa.binary()),
        ]
        names = ["key", "n_tokens", "ids_digest", "decoded_digest"]
        if whole:
            columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            names += ["ids", "decoded"]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _sha(text: str) -> bytes:
    return hashlib.sha256(text.encode()).digest()


def encode_decode(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, path: str | None = None,
    bits: int = BITS, whole: bool = False,
) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document; with ``whole`` also ids and decoded text."""
    filled = F.coalesce(F.col(text), F.lit(""))
    named = docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.md5(filled)).alias("_key"), filled.alias("_text"))
    slim = named.select("_key", "_text")
    refs = pinned(slim.mapInArrow(lambda b: _cuts(b, bits), REFS), "chunk-places")
    place = F.struct("key", "start", "size")
    # Two places differ if their hashes do; should two hashes be equal, a chunk would only not count as shared.
    at = F.xxhash64("key", "start")
    shared = refs.groupBy("hash").agg(F.min(place).alias("home"), F.min(at).alias("least"), F.max(at).alias("most")).where("least <> most")
    homes = shared.groupBy(F.col("home.key").alias("_key")).agg(
        F.collect_list(F.struct(F.col("home.start").alias("start"), F.col("home.size").alias("size"), "hash")).alias("homes")
    )
    # Equal texts become one row before they are shuffled. One shuffle serves both joins below if their sides are alike
    # to the last filter; a key is never NULL, but its expression could be, and an inner join would filter one side alone.
    packed = slim.where(F.col("_key").isNotNull()).mapInArrow(_pack, PACKED)
    texts = packed.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.any_value("_packed").alias("_packed"))
    coded = texts.join(homes, "_key").mapInArrow(lambda b: _encode_homes(b, vocabulary, path), "hash binary, ids binary")
    used = refs.join(coded, "hash").groupBy(F.col("key").alias("_key")).agg(
        F.collect_list(F.struct("start", "size", "ids")).alias("chunks")
    )
    made = texts.join(used, "_key", "left").mapInArrow(
        lambda b: _assemble(b, vocabulary, path, whole), WHOLE if whole else RESULT
    )
    results = pinned(made, "encoded-texts")
    shown = [F.lower(F.hex(f"{c}_digest")).alias(f"{c}_sha256") for c in ("ids", "decoded")]
    met = named.select("doc_id", "_key").join(results, F.col("_key") == F.col("key"))
    return met.select("doc_id", "n_tokens", *shown, *(["ids", "decoded"] if whole else []))
