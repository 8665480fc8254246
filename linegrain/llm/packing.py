"""Packing documents into sequences with a grouping genetic algorithm.

Documents longer than a sequence are cut into full pieces and a rest. Full
pieces are sequences of their own. All other pieces are dealt by hash into
shards of some thousand pieces, and each shard is evolved on several islands,
one Spark task each. An individual is a set of bins:

* crossover injects whole well-filled bins of one parent into the other,
  drops the bins there that hold one of their pieces, and best-fits the
  displaced pieces, longest first;
* mutation dissolves the emptiest bins and best-fits their pieces;
* between epochs each island passes its elite on to the next one.

A shard is done when it needs no more bins than its tokens fill. The emptiest
bins of all shards are then dissolved together and packed again in fewer
shards, level by level, until one shard is left, so that cutting the work
costs hardly a bin.

NULL and empty texts give the end id alone. Repeated rows are packed each.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linegrain.llm.common import pinned, steps
from linegrain.llm.tokens import encoder, with_ends

CAPACITY = 4096
VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Pieces of a shard, islands of a shard, epochs, and what an epoch does on an island.
SHARD, ISLANDS, EPOCHS, PEOPLE, CHILDREN = 2_000, 2, 2, 4, 6
#: Emptiest bins that each shard gives to the next level.
RELEASED = 2

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(batches: Iterator[pa.RecordBatch], name: str, end: int, capacity: int) -> Iterator[pa.RecordBatch]:
    library = encoder(name)
    for part in steps(batches, "_text"):
        ids, counts = with_ends(*library.encode_many(part.column("_text").to_pylist()), end)
        ids = ids.astype("<u4")
        rows: list[tuple] = []
        for doc_id, stop, n in zip(part.column("doc_id").to_pylist(), np.cumsum(counts).tolist(), counts.tolist(), strict=True):
            for piece, start in enumerate(range(0, n, capacity)):
                own = ids[stop - n + start : stop - n + min(start + capacity, n)]
                rows.append((doc_id, piece, start, len(own), zlib.crc32(own.tobytes())))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])


def pieces(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
    end_id: int = END_ID, capacity: int = CAPACITY,
) -> DataFrame:
    """The pieces of all documents with their place in the document and the checksum of their ids."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    return slim.mapInArrow(lambda batches: _cut(batches, vocabulary, end_id, capacity), PIECES)


class _Packing:
    """One individual: bins of piece numbers, and the room left in each."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins: dict[int, list[int]] = {}
        self.room: dict[int, int] = {}
        self.next = 0

    def add_bin(self, items: list[int]) -> int:
        self.bins[self.next] = list(items)
        self.room[self.next] = self.capacity - sum(self.lengths[i] for i in items)
        self.next += 1
        return self.next - 1

    def best_fit(self, items: list[int], rng: np.random.Generator | None = None) -> None:
        """Puts pieces into the fullest bins that can take them, longest first; ``rng`` disturbs the order."""
        rooms = sorted((r, b) for b, r in self.room.items() if r)
        size = self.lengths
        weight = {i: size[i] * (1 if rng is None else 1 + 0.1 * rng.random()) for i in items}
        for i in sorted(items, key=lambda i: -weight[i]):
            at = bisect_left(rooms, (size[i], -1))
            if at == len(rooms):
                b = self.add_bin([i])
            else:
                _, b = rooms.pop(at)
                self.bins[b].append(i)
                self.room[b] -= size[i]
            if self.room[b]:
                insort(rooms, (self.room[b], b))

    def copy(self) -> _Packing:
        other = _Packing(self.lengths, self.capacity)
        other.bins = {b: list(x) for b, x in self.bins.items()}
        other.room, other.next = dict(self.room), self.next
        return other

    def fitness(self) -> float:
        """Mean square of the fill; more for few bins and for a few full ones beside an empty one."""
        return float(np.mean([(1 - r / self.capacity) ** 2 for r in self.room.values()]))

    def dissolve(self, chosen: list[int]) -> list[int]:
        items = [i for b in chosen for i in self.bins.pop(b)]
        for b in chosen:
            del self.room[b]
        return items


def _crossover(a: _Packing, b: _Packing, rng: np.random.Generator) -> _Packing:
    """A child of ``a`` that has well-filled bins of ``b``."""
    child = a.copy()
    full = sorted(b.bins, key=lambda x: b.room[x])
    full = full[: max(1, len(full) // 2)]
    start = int(rng.integers(len(full)))
    injected = [b.bins[x] for x in full[start : start + max(1, len(full) // 3)]]
    new = {i for items in injected for i in items}
    hit = [x for x, items in child.bins.items() if not new.isdisjoint(items)]
    displaced = [i for i in child.dissolve(hit) if i not in new]
    for items in injected:
        child.add_bin(items)
    child.best_fit(displaced)
    return child


def _mutate(child: _Packing, rng: np.random.Generator) -> None:
    empty = sorted(child.bins, key=lambda x: -child.room[x])[: 2 + int(rng.integers(max(1, len(child.bins) // 20)))]
    child.best_fit(child.dissolve(empty), rng)


def evolve(
    lengths: list[int], capacity: int, seed: list[int], people: int = PEOPLE, children: int = CHILDREN,
    migrants: list[list[list[int]]] = (),
) -> _Packing:
    """The best packing of an island after one epoch; ``migrants`` are packings that came to it."""
    rng = np.random.default_rng(seed)
    least = -(-sum(lengths) // capacity)
    items = list(range(len(lengths)))
    crowd = []
    for bins in migrants:
        crowd.append(_Packing(lengths, capacity))
        for x in bins:
            crowd[-1].add_bin(x)
    if not crowd:
        crowd.append(_Packing(lengths, capacity))
        crowd[0].best_fit(items)
    if min(len(x.bins) for x in crowd) <= least:
        return min(crowd, key=lambda x: len(x.bins))
    while len(crowd) < people:
        crowd.append(_Packing(lengths, capacity))
        crowd[-1].best_fit(items, rng)
    key = lambda x: (len(x.bins), -x.fitness())
    for _ in range(children):
        crowd.sort(key=key)
        if len(crowd[0].bins) <= least:
            break
        a, b = crowd[0], crowd[1 + int(rng.integers(len(crowd) - 1))]
        child = _crossover(*((a, b) if rng.random() < 0.5 else (b, a)), rng)
        _mutate(child, rng)
        crowd[-1] = child
    return min(crowd, key=key)


def _island(pdf: pd.DataFrame, capacity: int, epoch: int) -> pd.DataFrame:
    """One epoch of one island. Columns bin_0, bin_1, … hold the packings that live or came here."""
    pdf = pdf.sort_values(["length", "pid"], ascending=[False, True]).reset_index(drop=True)
    came = []
    for c in [c for c in pdf.columns if c.startswith("bin_")]:
        came.append([list(x) for x in pdf.groupby(c, sort=True).indices.values()])
    shard, island = int(pdf["shard"].iloc[0]), int(pdf["island"].iloc[0])
    lengths = pdf["length"].tolist()
    best = evolve(lengths, capacity, [shard, island, epoch], migrants=came)
    number = np.zeros(len(pdf), np.int32)
    for k, items in enumerate(best.bins.values()):
        number[items] = k
    return pdf[["shard", "island", "pid", "length"]].assign(
        bin=number, n_bins=np.int32(len(best.bins)), least=np.int32(-(-sum(lengths) // capacity)), fitness=best.fitness()
    )


def _epoch(capacity: int, epoch: int):
    return lambda pdf: _island(pdf, capacity, epoch)


_LIVED = "shard long, island int, pid long, length long, bin int, n_bins int, least int, fitness double"


def _pack_level(items: DataFrame, shards: int, islands: int, epochs: int, capacity: int) -> DataFrame:
    """(shard, pid, length, bin) of the best island of each shard."""
    dealt = items.select("pid", "length", F.pmod(F.xxhash64("pid", F.lit(shards)), F.lit(shards)).alias("shard"))
    all_islands = F.explode(F.array(*[F.lit(i) for i in range(islands)]))
    lived = dealt.withColumn("island", all_islands).groupBy("shard", "island").applyInPandas(
        _epoch(capacity, 0), _LIVED
    )
    for epoch in range(1, epochs):
        lived = pinned(lived, "pack-islands")
        done = lived.where("n_bins <= least").select("shard").distinct()
        open_ = lived.join(done, "shard", "left_anti")
        # an island keeps its own elite and gets that of the one before
        here = open_.select("shard", "island", "pid", "length", F.col("bin").alias("bin_0"))
        came = open_.select(
            "shard", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), "pid", F.col("bin").alias("bin_1")
        )
        met = here.join(came, ["shard", "island", "pid"])
        next_ = met.groupBy("shard", "island").applyInPandas(_epoch(capacity, epoch), _LIVED)
        lived = lived.join(done, "shard", "left_semi").unionByName(next_)
    lived = pinned(lived, "pack-lived")
    best = (
        lived.select("shard", "island", "n_bins", "fitness").distinct()
        .groupBy("shard").agg(F.min(F.struct("n_bins", -F.col("fitness"), "island")).alias("b"))
        .select("shard", F.col("b.island").alias("island"))
    )
    return lived.join(best, ["shard", "island"]).select("shard", "pid", "length", "bin")


def pack(
    items: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS
) -> DataFrame:
    """(pid, sequence_id, offset) for items of (pid, length), no length above ``capacity``."""
    full = items.where(F.col("length") >= capacity).select(
        "pid", (F.col("pid") + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    left = pinned(items.where(F.col("length") < capacity).select("pid", "length"), "pack-items")
    placed, level, shards = None, 0, None
    while True:
        # Very short pieces may all be released, so the shards of a level are an eighth of the last one's at most.
        wanted = -(-left.count() // shard) or 1
        shards = wanted if shards is None else min(wanted, max(1, shards // 8))
        found = pinned(_pack_level(left, shards, islands, epochs, capacity), "pack-level")
        if shards > 1:
            fills = found.groupBy("shard", "bin").agg(F.sum("length").alias("fill"))
            # a shard's bins are bounded by its pieces
            order = F.row_number().over(W.partitionBy("shard").orderBy("fill", "bin"))
            released = fills.withColumn("_no", order).where(F.col("_no") <= RELEASED).select("shard", "bin")
            left = pinned(found.join(released, ["shard", "bin"], "left_semi").select("pid", "length"), "pack-items")
            found = found.join(released, ["shard", "bin"], "left_anti")
        numbered = found.select(
            "pid", "length",
            (F.lit(level).cast("long") * (1 << 56) + F.col("shard") * (1 << 16) + F.col("bin")).alias("sequence_id"),
        )
        placed = numbered if placed is None else placed.unionByName(numbered)
        if shards == 1:
            break
        level += 1
    bin_order = W.partitionBy("sequence_id").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)
    before = F.sum("length").over(bin_order)
    offsets = placed.withColumn("offset", F.coalesce(before, F.lit(0)).cast("long")).select("pid", "sequence_id", "offset")
    return offsets.unionByName(full)


def pack_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
    end_id: int = END_ID, capacity: int = CAPACITY,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    cut = pieces(docs, doc_id, text, vocabulary, end_id, capacity)
    cut = pinned(cut.withColumn("pid", F.monotonically_increasing_id()), "pack-pieces")
    return cut.join(pack(cut.select("pid", "length"), capacity), "pid").drop("pid")
