"""Token ids in files of Simple-8b words.

A file holds blocks; a block holds some documents with consecutive places in
ascending order of doc_id. The ids of a block are one run of 64-bit
little-endian words. The low four bits of a word select how many ids of how
many bits its other 60 bits hold (:data:`SELECTORS`); ids that need more than
60 bits are escapes: their word points into the block's list of 64-bit values.
A document begins with a new word, so a block can be read from the middle by
the word offsets that it keeps of its documents.

Blocks are rows of Parquet files, because Spark commits those as a whole even
if executors are lost: ``shard`` and ``block`` (place), ``first`` (ids before
it in its shard), ``doc_id``, ``n_tokens`` and ``word_offset`` (a value for
each document), ``words`` and ``escapes`` (bytes).

Decoding takes a whole block at once: a step per selector, not per id.

NULL and empty texts hold the end id alone. Rows with equal or NULL doc_id are
documents of their own; NULL comes first, equal ids are ordered by content.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linegrain.llm.common import pinned, steps
from linegrain.llm.tokens import encoder, with_ends

#: Fixed values of the format: bits of an id and ids in a word, by selector.
SELECTORS = ((1, 60), (2, 30), (3, 20), (4, 15), (5, 12), (6, 10), (7, 8), (8, 7), (10, 6), (12, 5), (15, 4), (20, 3), (30, 2), (60, 1))
#: A run of zeros, the count in the word's other bits.
ZEROS = 14
ESCAPE = 15
#: A block is closed when it holds so many ids.
BLOCK_IDS = 1 << 17
VOCABULARY = "byte_bpe_50k.json"
END_ID = 0

BLOCKS = (
    "shard int, block int, first long, doc_id array<long>, n_tokens array<int>, "
    "word_offset array<int>, words binary, escapes binary"
)


#: Bits of every id below 2**16, and the least number of every width.
_WIDTH = np.array([i.bit_length() for i in range(1 << 16)], np.uint8)
_LEAST = np.uint64(1) << np.arange(64, dtype=np.uint64)
_MOST = max(c for _, c in SELECTORS)
#: Ids in a word by selector; a run of zeros has its own count.
_HELD = np.array([c for _, c in SELECTORS] + [0, 1])


def _widths(ids: np.ndarray) -> np.ndarray:
    if not len(ids) or int(ids.max()) < len(_WIDTH):
        return _WIDTH[ids.astype(np.int64)]
    return np.searchsorted(_LEAST, ids, "right").astype(np.uint8)


def _widest(width: np.ndarray, at: np.ndarray) -> dict[int, np.ndarray]:
    """For each count of the format, the widest of so many ids from each place on."""
    found: dict[int, np.ndarray] = {}
    made, size = width, 1
    for count in sorted(c for _, c in SELECTORS):
        while size < count:
            step = min(size, count - size)
            after = np.zeros_like(made)
            after[:-step] = made[step:]
            made, size = np.maximum(made, after), size + step
        found[count] = made[at]
    return found


def pack(ids: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Simple-8b words and escapes of unsigned ids, and how many of both each document has.

    ``counts`` are the numbers of ids of the documents, one document if not
    given; each begins with a new word, and its escapes count from 0. For every
    place, the densest selector that fits is found for all places at once; then
    the words' places are followed from the first id to the last.
    """
    ids = np.asarray(ids, np.uint64)
    counts = np.array([len(ids)]) if counts is None else np.asarray(counts, np.int64)
    n = len(ids)
    document = np.repeat(np.arange(len(counts)), counts)
    stop = np.repeat(np.cumsum(counts), counts)
    place = np.arange(n)
    # Between documents lie places of no width, so that no window reaches into the next one.
    at = place + document * _MOST
    width = np.zeros(n + len(counts) * _MOST + 1, np.uint8)
    width[at] = _widths(ids)
    widest = _widest(width, at)
    choice = np.full(n, ESCAPE, np.int8)
    for selector in range(len(SELECTORS) - 1, -1, -1):
        bits, count = SELECTORS[selector]
        np.copyto(choice, np.int8(selector), where=widest[count] <= bits)
    step = np.minimum(_HELD[choice], stop - place)
    if np.count_nonzero(ids == 0) > _MOST:
        zeros = np.minimum(np.minimum.accumulate(np.where(ids != 0, place, n)[::-1])[::-1], stop) - place
        long_run = zeros > _MOST
        choice[long_run], step[long_run] = ZEROS, zeros[long_run]
    jump, found, i = step.tolist(), [], 0
    while i < n:
        found.append(i)
        i += jump[i]
    at = np.array(found, np.int64)
    selector, sizes = choice[at], step[at]
    words = selector.astype(np.uint64)
    for s, (bits, count) in enumerate(SELECTORS):
        which = np.flatnonzero(selector == s)
        for k in range(count if len(which) else 0):
            inside = which[sizes[which] > k]
            words[inside] |= ids[at[inside] + k] << np.uint64(4 + bits * k)
    words[selector == ZEROS] |= sizes[selector == ZEROS].astype(np.uint64) << np.uint64(4)
    out = np.flatnonzero(selector == ESCAPE)
    n_words = np.bincount(document[at], minlength=len(counts))
    n_escapes = np.bincount(document[at[out]], minlength=len(counts))
    own = np.arange(len(out)) - np.repeat(np.cumsum(n_escapes) - n_escapes, n_escapes)
    words[out] |= own.astype(np.uint64) << np.uint64(4)
    return words, ids[at[out]], n_words, n_escapes


def unpack(words: np.ndarray, escapes: np.ndarray, lasts: np.ndarray, n_ids: np.ndarray) -> np.ndarray:
    """The ids of all documents of a block.

    ``lasts`` are the word numbers behind each document, ``n_ids`` their ids:
    the last word of a document may hold fewer ids than its selector allows.
    """
    selector = (words & np.uint64(15)).astype(np.int64)
    body = words >> np.uint64(4)
    count = _HELD[selector]
    count[selector == ZEROS] = body[selector == ZEROS].astype(np.int64)
    firsts = np.concatenate([[0], lasts[:-1]])
    held = np.concatenate([[0], np.cumsum(count)])
    count[lasts - 1] -= held[lasts] - held[firsts] - n_ids
    begin = np.cumsum(count) - count
    ids = np.zeros(int(count.sum()), np.uint64)
    for s, (bits, most) in enumerate(SELECTORS):
        which = np.flatnonzero(selector == s)
        mask = np.uint64((1 << bits) - 1)
        for k in range(most if len(which) else 0):
            inside = which[count[which] > k]
            ids[begin[inside] + k] = (body[inside] >> np.uint64(bits * k)) & mask
    out = np.flatnonzero(selector == ESCAPE)
    ids[begin[out]] = escapes[body[out].astype(np.int64)]
    return ids


class _Block:
    def __init__(self, shard: int):
        self.shard, self.block, self.first = shard, 0, 0
        self.clear()

    def clear(self) -> None:
        self.ids, self.n, self.offsets, self.words, self.escapes, self.size, self.n_escapes, self.n_ids = [], [], [], [], [], 0, 0, 0

    def add(self, doc_id, n: int, words: bytes | memoryview, escapes: bytes | memoryview) -> None:
        if escapes:  # their places move by what the block has already
            w = np.frombuffer(words, np.uint64).copy()
            w[(w & np.uint64(15)) == ESCAPE] += np.uint64(self.n_escapes << 4)
            words = w.tobytes()
        self.ids.append(doc_id)
        self.n.append(n)
        self.n_ids += n
        self.size += len(words) // 8
        self.offsets.append(self.size)
        self.words.append(words)
        self.escapes.append(escapes)
        self.n_escapes += len(escapes) // 8

    def close(self) -> dict:
        row = {
            "shard": self.shard, "block": self.block, "first": self.first, "doc_id": self.ids, "n_tokens": self.n,
            "word_offset": self.offsets, "words": b"".join(self.words), "escapes": b"".join(self.escapes),
        }
        self.block += 1
        self.first += self.n_ids
        self.clear()
        return row


_ARROW = pa.schema(
    [
        ("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("doc_id", pa.list_(pa.int64())),
        ("n_tokens", pa.list_(pa.int32())), ("word_offset", pa.list_(pa.int32())), ("words", pa.binary()), ("escapes", pa.binary()),
    ]
)


def _blocks(batches: Iterator[pa.RecordBatch], name: str, end: int | None, path: str | None, most: int) -> Iterator[pa.RecordBatch]:
    """Blocks of one range partition; its documents come in order."""
    library = encoder(name, path)
    block = None
    for part in steps(batches, "_text"):
        block = block or _Block(part.column("shard")[0].as_py())
        ids, n = with_ends(*library.encode_many(part.column("_text").to_pylist()), end)
        words, escapes, n_words, n_escapes = pack(ids, n)
        words, escapes = memoryview(words.astype("<u8").tobytes()), memoryview(escapes.astype("<u8").tobytes())
        at = odd = 0
        sizes = zip(part.column("doc_id").to_pylist(), n.tolist(), n_words.tolist(), n_escapes.tolist(), strict=True)
        for doc_id, count, n_word, n_odd in sizes:
            block.add(doc_id, count, words[at : at + 8 * n_word], escapes[odd : odd + 8 * n_odd])
            at, odd = at + 8 * n_word, odd + 8 * n_odd
            if block.n_ids >= most:
                yield pa.RecordBatch.from_pylist([block.close()], schema=_ARROW)
    if block and block.n:
        yield pa.RecordBatch.from_pylist([block.close()], schema=_ARROW)


def write_token_files(
    docs: DataFrame,
    folder: str | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    vocabulary: str = VOCABULARY,
    end_id: int | None = END_ID,
    block_ids: int = BLOCK_IDS,
    vocabulary_path: str | None = None,
) -> DataFrame:
    """Writes the blocks of all documents and returns them as read back from the files.

    ``folder`` is where the files go; by default below the checkpoint folder.
    """
    # Ranges are cut before texts are encoded, so each is encoded once; the hash parts rows without an id.
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text"))
    ordered = slim.repartitionByRange("doc_id", "_hash").sortWithinPartitions("doc_id", "_hash", "_text")
    blocks = ordered.select("doc_id", "_text", F.spark_partition_id().alias("shard")).mapInArrow(
        lambda batches: _blocks(batches, vocabulary, end_id, vocabulary_path, block_ids), BLOCKS
    )
    if folder is None:
        return pinned(blocks, "token-files")
    blocks.write.parquet(folder)
    return docs.sparkSession.read.schema(BLOCKS).parquet(folder)


def decode_block(row: dict) -> list[np.ndarray]:
    """The ids of each document of a block."""
    n = np.array(row["n_tokens"], np.int64)
    ids = unpack(
        np.frombuffer(row["words"], np.uint64), np.frombuffer(row["escapes"], np.uint64), np.array(row["word_offset"], np.int64), n
    )
    return np.split(ids, np.cumsum(n)[:-1])


def _checks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = decode_block(row)
            n = np.array(row["n_tokens"], np.int64)
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
            before = row["first"] + np.cumsum(n) - n
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(n), row["shard"], np.int32)), pa.array(row["doc_id"], pa.int64()),
                    pa.array(before), pa.array(n), pa.array(crc, pa.int64()),
                ],
                names=["shard", "doc_id", "_before", "n_tokens", "ids_crc32"],
            )


def read_checks(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    # One row per shard, that is per partition of the writing job, is summed centrally.
    sizes = blocks.groupBy("shard").agg(
        F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("_size")
    )
    earlier = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("shard", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_shard_start"))
    found = blocks.mapInArrow(_checks, "shard int, doc_id long, _before long, n_tokens long, ids_crc32 long")
    return found.join(F.broadcast(offsets), "shard").select(
        "doc_id", (F.col("_shard_start") + F.col("_before")).cast("long").alias("start"), "n_tokens", "ids_crc32"
    )
