"""Removing long repeats by anchored hash grouping, in place of prefix doubling.

A byte goes if a string of ``SIZE`` bytes that covers it also starts anywhere
else. Ranking every byte position would shuffle some 20 bytes for each byte of
doubling round, so three fixed lengths of content are hashed, grouped and
counted at positions that the content chooses, which loses nothing:

* each window of SIZE bytes has one anchor: the core of CORE bytes with the
  least hash among those that start in its first SIZE - CORE + 1 bytes. Equal
  windows have the same anchor at the same place, so windows that follow each
  other and have one anchor are one item: (anchor, least and most offset);
* rank: the class of equal bytes that an item's windows have in common, here
  the core. An item whose rank is unique holds no repeat and goes;
* an item whose whole stretch is found twice with the same offsets is repeated
  all over, past the threshold, and is done;
* the others are ranked again by a longer common part: offsets are dealt into
  cells of CELL neighbours, whose common part has SIZE - CELL + 1 bytes, and
  then into single windows of SIZE bytes. Of equal items only one stays as the
  partner of the others.

Ranks are pairs of 64-bit hashes (of the common part and of the stretch),
grouped and counted by Spark. Texts are bytes of UTF-8; matches never cross
documents; NULL is empty. Equal rows repeat each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linegrain.llm.common import STEP_BYTES, mixed, pinned, powers, steps, text_bytes

SIZE, CORE, CELL = 200, 40, 8
_REACH = SIZE - CORE  # the largest offset of an anchor in its window

_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_TABLES = np.random.default_rng(77_003).integers(0, 1 << 64, (2, 256), dtype=np.uint64)
_PLACE = np.uint64(0xFFFFFF)


def _inverse(odd: np.uint64) -> np.uint64:
    return np.uint64(pow(int(odd), -1, 1 << 64))


class _Hashes:
    """Hashes of any stretches of a byte array, from running sums."""

    kept: dict = {}

    def __init__(self, data: np.ndarray, which: int):
        n = max(len(data) + 1, STEP_BYTES + 4096)
        if which not in self.kept or len(self.kept[which][0]) < n:
            base = (_ONE, _TWO)[which]
            self.kept[which] = (powers(n, base), powers(n, _inverse(base)))
        power, self.back = self.kept[which]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLES[which][data] * power[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start])


def _items(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Items of texts: text, anchor (place in data), least and most offset, two hashes."""
    sizes = np.maximum(np.diff(offsets) - SIZE + 1, 0)
    if not sizes.sum():
        none = np.zeros(0, np.int64)
        return {"text": none, "anchor": none, "low": none, "high": none, "core": none, "stretch": none}
    one, two = _Hashes(data, 0), _Hashes(data, 1)
    places = np.arange(len(data) - CORE + 1)
    least = (one(places, places + CORE) & ~_PLACE) | (_PLACE - places.astype(np.uint64))
    width, span = _REACH + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    anchor = (_PLACE - (least & _PLACE)).astype(np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    start = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + offsets[text]
    at = anchor[start]
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    a, high, low = at[first], at[first] - start[first], at[last] - start[last]
    shape = (high * 256 + low).astype(np.uint64)
    stretch = mixed(two(a - high, a - low + SIZE) + shape)
    return {
        "text": text[first], "anchor": a, "low": low, "high": high,
        "core": one(a, a + CORE).view(np.int64), "stretch": stretch.view(np.int64),
    }


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(data, offsets, bytes before) in steps of bounded size; a longer text overlaps its next piece."""
    if len(data) <= STEP_BYTES * 2:
        yield data, offsets, np.zeros(len(offsets) - 1, np.int64)
        return
    for i in range(len(offsets) - 1):  # a step holds one such text
        begin, end = offsets[i], offsets[i + 1]
        for at in range(0, max(1, end - begin - SIZE + 1), STEP_BYTES):
            stop = min(begin + at + STEP_BYTES + SIZE - 1, end)
            bounds = np.zeros(len(offsets), np.int64)
            bounds[i + 1 :] = stop - begin - at
            yield data[begin + at : stop], bounds, np.where(np.arange(len(offsets) - 1) == i, at, 0)


def _anchored(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    for part in steps(batches, "_text"):
        data, offsets = text_bytes(part.column("_text"))
        for own, bounds, before in _pieces(data, offsets):
            found = _items(own, bounds)
            text = found.pop("text")
            place = found.pop("anchor") - bounds[text] + before[text]
            rows = pa.array(text)
            arrays = [part.column(k).take(rows) for k in keys]
            arrays += [pa.array(place), pa.array(found["low"], pa.int16()), pa.array(found["high"], pa.int16())]
            arrays += [pa.array(found["core"]), pa.array(found["stretch"])]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "anchor", "low", "high", "core", "stretch"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around wanted anchors, all that their windows can hold."""
    for batch in batches:
        texts = batch.column("_text").cast(pa.large_binary())
        out: dict = {k: [] for k in ("doc", "content", "anchor", "low", "high", "copies", "context")}
        for i, wanted in enumerate(batch.column("wanted").to_pylist()):
            text = texts[i].as_py() or b""
            for w in wanted:
                a = w["anchor"]
                out["context"].append(text[a - w["high"] : a - w["low"] + SIZE])
                for k in ("anchor", "low", "high", "copies"):
                    out[k].append(w[k])
                out["doc"].append(batch.column("doc")[i].as_py())
                out["content"].append(batch.column("content")[i].as_py())
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))


def _cells(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Items dealt into cells of ``width`` offsets, with the hashes of common part and stretch."""
    for part in steps(batches, "context"):
        data, offsets = text_bytes(part.column("context"))
        low, high, above = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("low", "high", "top"))
        first, last = low // width, high // width
        count = last - first + 1
        item = np.repeat(np.arange(len(low)), count)
        cell = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[item]
        c_low, c_high = np.maximum(cell * width, low[item]), np.minimum(cell * width + width - 1, high[item])
        anchor = offsets[item] + above[item]  # its place in data
        if len(data):
            one, two = _Hashes(data, 0), _Hashes(data, 1)
            # what all windows of the whole cell have in common, whether they are here or not
            core = one(anchor - cell * width, anchor - (cell * width + width - 1) + SIZE)
            shape = (c_high * 256 + c_low).astype(np.uint64)
            stretch = mixed(two(anchor - c_high, anchor - c_low + SIZE) + shape)
        else:
            core = stretch = np.zeros(0, np.uint64)
        rows = pa.array(item)
        arrays = [part.column(c).take(rows) for c in ("iid", "copies")]
        arrays += [pa.array(c_low, pa.int16()), pa.array(c_high, pa.int16()), pa.array(core.view(np.int64)), pa.array(stretch.view(np.int64))]
        yield pa.RecordBatch.from_arrays(arrays, names=["iid", "copies", "low", "high", "core", "stretch"])


_CELLS = "iid long, copies long, low short, high short, core long, stretch long"


def _ranked(items: DataFrame, name: str) -> DataFrame:
    """Items whose rank is shared."""
    ranks = items.groupBy("core").agg(F.sum("copies").alias("n")).where("n > 1").select("core")
    return pinned(items.join(ranks, "core"), f"{name}-shared")


def _classes(shared: DataFrame, ids: list[str]) -> DataFrame:
    """(core, stretch, n, rep): one row per class of equal stretches."""
    return shared.groupBy("core", "stretch").agg(
        F.sum("copies").alias("n"), F.min(F.struct(*ids, "low", "high")).alias("rep")
    )


def _open(classes: DataFrame) -> DataFrame:
    """Classes that are single or stand beside another class of the same rank."""
    kinds = classes.groupBy("core").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
    kinds = kinds.where("kinds > 1 and least = 1").select("core")
    return classes.join(kinds, "core").select("rep.*", F.col("n").alias("copies"))


def repeated_stretches(docs: DataFrame) -> DataFrame:
    """(doc, content, start, end): stretches of repeated windows of ``docs`` (doc, content, _text)."""
    anchors = docs.mapInArrow(
        lambda b: _anchored(b, ["doc", "content"]),
        "doc long, content long, anchor long, low short, high short, core long, stretch long",
    )
    # found twice, for the ranks and for the items that share one: cheaper than all of them on disk to the end
    shared = _ranked(anchors.withColumn("copies", F.lit(1).cast("long")), "repeat")
    place = ["doc", "content", "anchor"]
    classes = pinned(_classes(shared, place), "repeat-classes")
    whole = shared.join(classes.where("n > 1").select("core", "stretch"), ["core", "stretch"])
    done = whole.select("doc", "content", "anchor", "low", "high")

    # one list per text: its own anchors
    wanted = _open(classes).groupBy("doc", "content").agg(
        F.collect_list(F.struct("anchor", "low", "high", "copies")).alias("wanted")
    )
    wanted = wanted.withColumnsRenamed({"doc": "w_doc", "content": "w_content"})
    same = F.col("doc").eqNullSafe(F.col("w_doc")) & (F.col("content") == F.col("w_content"))
    texts = docs.join(wanted, same).select("doc", "content", "_text", "wanted")
    around = texts.mapInArrow(
        _contexts, "doc long, content long, anchor long, low short, high short, copies long, context binary"
    )
    items = pinned(around.withColumn("iid", F.monotonically_increasing_id()), "repeat-items")

    found = None
    dealt = items.select("iid", "low", "high", F.col("high").alias("top"), "copies", "context")
    for width in (CELL, 1):
        cells = dealt.mapInArrow(partial(_cells, width=width), _CELLS)
        if width == 1:  # these stand behind a join, the others are dealt again from the items
            cells = pinned(cells, "repeat-cells-1")
        shared = _ranked(cells, f"repeat-{width}")
        classes = pinned(_classes(shared, ["iid"]), f"repeat-classes-{width}")
        hits = shared.where("copies = 1").join(classes.where("n > 1").select("core", "stretch"), ["core", "stretch"])
        hits = hits.select("iid", "low", "high")
        found = hits if found is None else found.unionByName(hits)
        if width > 1:
            again = _open(classes)
            rows = items.select("iid", F.col("high").alias("top"), "context")
            dealt = again.join(rows, "iid").select("iid", "low", "high", "top", "copies", "context")
    cells = found.join(items.select("iid", "doc", "content", "anchor"), "iid").select("doc", "content", "anchor", "low", "high")
    return done.unionByName(cells).select(
        "doc", "content", (F.col("anchor") - F.col("high")).alias("start"), (F.col("anchor") - F.col("low") + SIZE).alias("end")
    )


def _runs(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of a union of stretches."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, ends, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _apply(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("_text").cast(pa.large_binary())
        n, removed, spans, digests, kept_texts = [], [], [], [], []
        for i, stretches in enumerate(batch.column("stretches").to_pylist()):
            text = texts[i].as_py() or b""
            runs = _runs([x["start"] for x in stretches or ()], [x["end"] for x in stretches or ()])
            kept, at = [], 0
            for a, b in runs:
                if with_text:  # a character goes only as a whole
                    while a < b and text[a] & 0xC0 == 0x80:
                        a += 1
                    while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
                        b -= 1
                kept.append(text[at:a])
                at = b
            rest = b"".join([*kept, text[at:]])
            n.append(len(text))
            removed.append(sum(b - a for a, b in runs))
            spans.append(len(runs))
            digests.append(hashlib.sha256(rest).hexdigest())
            if with_text:
                kept_texts.append(rest.decode("utf-8", "replace"))
        arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
        names = ["_row", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_text:
            arrays.append(pa.array(kept_texts, pa.string()))
            names.append("kept_text")
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None, with_text: bool = False
) -> DataFrame:
    """One row per document: its columns to ``carry`` as ``_row``, n_bytes, n_removed, n_spans,
    kept_sha256, and, if wanted, ``kept_text`` without the characters that lie whole in removed runs."""
    row = F.struct(*[F.col(c) for c in (docs.columns if carry is None else carry)]).alias("_row")
    base = docs.select(
        F.col(doc_id).cast("long").alias("doc"), F.xxhash64(F.col(doc_id), F.col(text)).alias("content"), F.col(text).alias("_text"), row
    )
    # equal rows give the same stretches; one list per text, bounded by its bytes
    lists = (
        repeated_stretches(base.select("doc", "content", "_text"))
        .distinct()
        .groupBy("doc", "content")
        .agg(F.collect_list(F.struct("start", "end")).alias("stretches"))
        .withColumnsRenamed({"doc": "s_doc", "content": "s_content"})
    )
    lists = pinned(lists, "repeat-stretches")
    same = F.col("doc").eqNullSafe(F.col("s_doc")) & (F.col("content") == F.col("s_content"))
    joined = base.join(lists, same, "left").select("_row", "_text", "stretches")
    kind = joined.schema["_row"].dataType.simpleString()
    schema = f"_row {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    return joined.mapInArrow(lambda b: _apply(b, with_text), schema)


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with repeats taken out of the text; a NULL text stays NULL."""
    found = remove_repeats(docs, doc_id, text, with_text=True)
    kept = F.when(F.col(f"_row.{text}").isNotNull(), F.col("kept_text")).alias(text)
    return found.select(*[kept if c == text else F.col(f"_row.{c}").alias(c) for c in docs.columns])
