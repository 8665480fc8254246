"""What the operators of this folder share: written intermediate tables and batches of texts."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linegrain.session import checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one numpy step takes; a longer text is a step of its own.
STEP_BYTES = 1 << 20
#: The same where a step's numbers take many times the memory of its text.
SMALL_STEP_BYTES = 1 << 18


#: Bytes of rows that go to a Python worker at once; both sides hold a batch in memory of their own.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside sends rows to Python in batches that end once they hold BATCH_BYTES."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def pinned(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the checkpoint folder, and read again.

    The written rows outlive executors, and what is read is the same at each
    use. Shuffle files of earlier steps go once the driver drops what refers to
    them, hence the collection of garbage.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return back


def unpinned(df: DataFrame) -> None:
    """Takes the files of :func:`pinned` rows away, once all that reads them is written itself."""
    spark = df.sparkSession
    root = checkpoint_dir(spark)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if path.getParent() != files.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(root)):
            raise ValueError(f"{folder} does not come from pinned()")
        files.delete(path, True)


def n_words(text: Column | str) -> Column:
    """Number of words of a text, 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def steps(batches: Iterator[pa.RecordBatch], column: str, size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches with about ``size`` bytes of text in ``column``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    # the worker lives on for other tasks, and so does what it has not given back
    pa.default_memory_pool().release_unused()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column after each other, and where each text starts; NULL is empty."""
    filled = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = filled.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(20_011).integers(0, 1 << 64, 256, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int, base: np.uint64 = _ODD) -> np.ndarray:
    factors = np.full(max(n, 1), base, np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


class Words:
    """The words of many texts at once: start, end, text number and 64-bit hash of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashes: bool = True):
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        self.data = data
        letter = ~_SPACE[data]
        first = letter.copy()
        first[1:] &= ~letter[:-1]
        last = letter.copy()
        last[:-1] &= ~letter[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        first[edges] = letter[edges]
        last[edges - 1] = letter[edges - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.text = np.searchsorted(offsets, self.start, "right") - 1
        self.per_text = np.bincount(self.text, minlength=len(offsets) - 1)
        self.offsets = offsets
        if hashes:
            self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        sizes = self.end - self.start
        begin = np.cumsum(sizes) - sizes
        place = np.arange(sizes.sum()) - np.repeat(begin, sizes)
        power = powers(int(sizes.max()))
        terms = _BYTES[self.data[np.repeat(self.start, sizes) + place]] * power[place]
        return mixed(np.add.reduceat(terms, begin) + sizes.astype(np.uint64))

    def first_word(self) -> np.ndarray:
        """The number of each text's first word."""
        return np.cumsum(self.per_text) - self.per_text

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(text number, hash) of every run of n words; a text with fewer words gives one run of all."""
        from_word, count = self.first_word(), self.per_text
        runs = np.where(count >= n, count - n + 1, np.minimum(count, 1))
        text = np.repeat(np.arange(len(count)), runs)
        at = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs) + from_word[text]
        size = np.minimum(count, n)[text]
        value = mixed(size.astype(np.uint64))
        for i in range(n):
            inside = size > i
            step = self.hash[np.where(inside, at + i, 0)] if len(self.hash) else np.zeros(len(at), np.uint64)
            value = np.where(inside, mixed(value * _ODD + step), value)
        return text, value
