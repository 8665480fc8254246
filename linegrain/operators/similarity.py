"""Pairs of similar sequences, found without comparing all pairs.

similarity = 0.4 LCS/m + 0.2 prefix/m + 0.2 suffix/m + 0.2 Jaccard, where m is
the longer length, n the shorter one, and o the multiset overlap of the tokens.

What a pair with similarity >= 0.5 must have:

* If o < n, prefix and suffix do not meet, so prefix + suffix <= LCS <= o and
  similarity <= 0.6 o/m + 0.2. Hence o >= m/2.
* If o = n, similarity <= 0.8 n/m + 0.2. Hence n >= 0.375 m.

So o >= t(n, m) = min(n, ceil(m/2)) and n >= 0.375 m. Tokens are numbered by
occurrence and ordered by rarity; two sequences that share t elements share
the first k <= t of their common elements within their first L - t + k
elements. Those k elements, with the length classes of the two, are the join
key.

The index that is joined holds numbers only: the key's hash, the sequence, its
length and the place of the key's last element. Where the first k common
elements end at places p and q, the overlap is at most k + min(n_a - p, n_b - q)
elements, so meetings behind which too few elements are left are dropped. The
sequences themselves are joined to the pairs that are left, once a pair. Keys
with many pairs are spread over a grid: either side is dealt into rows or
columns and copied along the other. Whether the LCS fits a word is decided by
pair.

With few distinct tokens nearly all pairs share keys, most of them several. Then
keys save nothing: sequences are dealt into blocks, and each pair of blocks is
one group in which a sequence is compared with all of the other block at once
(:func:`_block_pairs`). The pairs that come out are the same.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linegrain.scale import ordered_index
from linegrain.session import cut

THRESHOLD = 0.50
EXACT_CLASSES = 16  # lengths up to this are classes of their own
CLASS_RATIO = 1.25  # longer lengths fall in classes that grow by this
NATIVE_LCS = 60  # shorter length up to which a 64-bit word holds the LCS state
PAIRS_PER_TASK = 4_000_000
#: So many sequences are compared in blocks at once; more of them where keys would meet in a good part of all pairs.
FEW_SEQUENCES = 20_000
PAIRS_PER_MEETING = 8


def _class_of(length: Column) -> Column:
    grown = F.floor(F.log(length / EXACT_CLASSES) / F.log(F.lit(CLASS_RATIO)) + 1e-9)
    return F.when(length <= EXACT_CLASSES, length).otherwise(EXACT_CLASSES + 1 + grown).cast("int")


def _least_length(cls: Column) -> Column:
    """A lower bound of the lengths in a class."""
    grown = F.lit(EXACT_CLASSES) * F.pow(F.lit(CLASS_RATIO), cls - EXACT_CLASSES - 1)
    return F.when(cls <= EXACT_CLASSES, cls).otherwise(F.floor(grown - 1e-6)).cast("int")


def _half(length: Column) -> Column:
    return F.ceil(length / 2).cast("int")


def _key_size(short_class: Column, long_class: Column) -> Column:
    """How many common elements make a key; never more than the pair must share."""
    least = F.least(_least_length(short_class), _half(_least_length(long_class)))
    wanted = F.when(long_class <= 8, 3).when(long_class <= EXACT_CLASSES + 2, 2).otherwise(1)
    return F.greatest(F.lit(1), F.least(wanted, least))


def _subsets(items: Column, size: Column) -> Column:
    """All subsets of one, two or three items in their order: (hash, place of the last item)."""

    def found(last: Column, *ids: Column) -> Column:
        return F.struct(F.xxhash64(*ids).alias("key"), last.alias("pos"))

    def later(place: Column) -> Column:
        rest = F.slice(items, place + 1, F.greatest(F.size(items) - place, F.lit(0)))
        return F.transform(rest, lambda x, i: F.struct(x.alias("x"), (place + i + 1).alias("i")))

    ones = F.transform(items, lambda x, i: F.struct(x.alias("x"), (i + 1).alias("i")))
    twos = F.flatten(
        F.transform(ones, lambda a: F.transform(later(a["i"]), lambda b: F.struct(a["x"].alias("x"), b["x"].alias("y"), b["i"].alias("i"))))
    )
    threes = F.flatten(
        F.transform(twos, lambda a: F.transform(later(a["i"]), lambda b: found(b["i"], a["x"], a["y"], b["x"])))
    )
    return (
        F.when(size == 1, F.transform(ones, lambda a: found(a["i"], a["x"])))
        .when(size == 2, F.transform(twos, lambda a: found(a["i"], a["x"], a["y"])))
        .otherwise(threes)
    )


def _with_elements(types: DataFrame) -> DataFrame:
    """(seq_no, len, elements): the numbers of each sequence's (token, occurrence) pairs, rarest first."""
    tokens = types.select("seq_no", F.explode("signs").alias("token")).groupBy("seq_no", "token").agg(F.count(F.lit(1)).alias("times"))
    each = tokens.select("seq_no", "token", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("nth"))
    counts = each.groupBy("token", "nth").agg(F.count(F.lit(1)).alias("n"))
    numbers = ordered_index(counts, ["n", "token", "nth"], "element").drop("n")
    ranked = each.join(numbers, ["token", "nth"]).groupBy("seq_no").agg(F.array_sort(F.collect_list("element")).alias("elements"))
    return ranked.withColumn("len", F.size("elements"))


def _keyed(seqs: DataFrame, classes: list[int]) -> DataFrame:
    """One row of numbers per sequence, class of the other sequence, and key."""
    own, other, length = F.col("own"), F.col("other"), F.col("len")
    nearest = _class_of(F.ceil(length * 0.375))
    farthest = _class_of(F.floor(length / 0.375))
    reachable = F.filter(
        F.array(*map(F.lit, classes)), lambda c: (c >= nearest) & (c <= farthest)
    )
    rows = seqs.withColumn("own", _class_of(length)).withColumn("other", F.explode(reachable))
    must_share = (
        F.when(other > own, F.least(length, _half(_least_length(other))))
        .when(other < own, F.least(_least_length(other), _half(length)))
        .otherwise(_half(length))
    )
    rows = rows.withColumns(
        {"short_class": F.least(own, other), "long_class": F.greatest(own, other)}
    ).withColumn("k", _key_size(F.col("short_class"), F.col("long_class")))
    kept = F.slice("elements", F.lit(1), length - must_share + F.col("k"))
    return rows.select(
        "seq_no",
        "len",
        "short_class",
        "long_class",
        "k",
        (own <= other).alias("as_short"),
        (own >= other).alias("as_long"),
        F.inline(_subsets(kept, F.col("k"))),
    )


GROUP = ["short_class", "long_class", "key"]


def _spread(keyed: DataFrame, pairs_per_task: int) -> DataFrame:
    """Add ``ways_s`` and ``ways_l``: the rows and columns over which a key's pairs are spread."""
    sizes = keyed.groupBy(*GROUP).agg(
        F.count_if("as_short").alias("s"), F.count_if("as_long").alias("l")
    )
    side = max(1, int(pairs_per_task**0.5))
    hot = sizes.where(F.col("s").cast("double") * F.col("l") > pairs_per_task).select(
        *GROUP, F.ceil(F.col("s") / side).cast("int").alias("ways_s"), F.ceil(F.col("l") / side).cast("int").alias("ways_l")
    )
    return keyed.join(hot, GROUP, "left").withColumns(
        {"ways_s": F.coalesce("ways_s", F.lit(1)), "ways_l": F.coalesce("ways_l", F.lit(1))}
    )


def candidates(seqs: DataFrame, pairs_per_task: int = PAIRS_PER_TASK) -> DataFrame:
    """(seq_no_a, seq_no_b, shorter): pairs of numbers that share a key and may be similar, each once."""
    # A handful of numbers: the classes grow with the logarithm of the longest sequence.
    classes = [r[0] for r in seqs.select(_class_of(F.col("len"))).distinct().collect()]
    keyed = _spread(_keyed(seqs, sorted(classes)), pairs_per_task)
    own = F.xxhash64("seq_no")
    body = [*GROUP, "k", "seq_no", "len", "pos"]
    mine_s, mine_l = F.pmod(own, F.col("ways_s")).cast("int"), F.pmod(own, F.col("ways_l")).cast("int")
    all_s, all_l = F.sequence(F.lit(0), F.col("ways_s") - 1), F.sequence(F.lit(0), F.col("ways_l") - 1)
    short = keyed.where("as_short").select(*body, "as_long", mine_s.alias("row"), F.explode(all_l).alias("col"))
    long = keyed.where("as_long").select(*body, F.explode(all_s).alias("row"), mine_l.alias("col"))
    met = short.alias("a").join(long.alias("b"), [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*GROUP, "row", "col"]])
    # Both in one class: each pair is wanted once, in order.
    met = met.where((~F.col("a.as_long") | (F.col("a.seq_no") < F.col("b.seq_no"))) & (F.col("a.seq_no") != F.col("b.seq_no")))
    n, m = F.least("a.len", "b.len"), F.greatest("a.len", "b.len")
    most = F.col("a.k") + F.least(F.col("a.len") - F.col("a.pos"), F.col("b.len") - F.col("b.pos"))
    near = met.where((most >= F.least(n, _half(m))) & (n >= 0.375 * m))
    return near.select(
        F.least("a.seq_no", "b.seq_no").alias("seq_no_a"), F.greatest("a.seq_no", "b.seq_no").alias("seq_no_b"), n.alias("shorter")
    ).distinct()


def _same_from(a: Column, b: Column) -> Column:
    """How many leading tokens of ``a`` and ``b`` agree."""
    n = F.least(F.size(a), F.size(b))
    same = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(a, i) == F.element_at(b, i))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, n.cast("long"))


def lcs_length(short: Column, long: Column) -> Column:
    """Longest common subsequence by bit-parallel dynamic programming in one 64-bit word.

    ``short`` may have up to ``NATIVE_LCS`` tokens. A zero bit in the state
    means that the common subsequence grows at that token.
    """
    one = F.lit(1).cast("long")

    def bit(i: Column) -> Column:
        return F.call_function("shiftleft", one, i.cast("int"))

    full = bit(F.size(short)) - 1
    at = F.transform(short, lambda t, i: F.struct(t.alias("t"), bit(i).alias("b")))

    def mask(token: Column) -> Column:
        return F.aggregate(
            at, F.lit(0).cast("long"), lambda m, e: F.when(e["t"] == token, m.bitwiseOR(e["b"])).otherwise(m)
        )

    def step(state: Column, token: Column) -> Column:
        hit = F.array(state.bitwiseAND(mask(token)))
        return F.aggregate(
            hit, F.lit(0).cast("long"),
            lambda _, u: (state + u).bitwiseOR(state - u).bitwiseAND(full),
        )

    state = F.aggregate(long, full, step)
    return F.size(short) - F.bit_count(state)


@F.pandas_udf(T.IntegerType())
def lcs_length_any(short: pd.Series, long: pd.Series) -> pd.Series:
    """The same for sequences of any length, on Python integers, in Arrow batches."""

    def one(a, b) -> int:
        full = (1 << len(a)) - 1
        masks: dict[str, int] = {}
        for i, token in enumerate(a):
            masks[token] = masks.get(token, 0) | (1 << i)
        state = full
        for token in b:
            hit = state & masks.get(token, 0)
            state = ((state + hit) | (state - hit)) & full
        return len(a) - state.bit_count()

    return pd.Series([one(a, b) for a, b in zip(short, long, strict=True)])


def _padded(signs: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, token numbers by place, -1 behind the end)."""
    lengths = pc.list_value_length(signs).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = np.full((len(signs), int(lengths.max(initial=0)) + 1), -1, np.int64)
    places = np.arange(codes.shape[1])
    codes[places < lengths[:, None]] = pc.list_flatten(signs).to_numpy(zero_copy_only=False)
    return lengths, codes


def _token_sets(codes: np.ndarray, tokens: int) -> np.ndarray:
    """The distinct tokens of each row as bits of words."""
    words = np.zeros((len(codes), tokens // 64 + 1), np.uint64)
    row, place = np.nonzero(codes >= 0)
    token = codes[row, place]
    np.bitwise_or.at(words, (row, token // 64), np.uint64(1) << (token % 64).astype(np.uint64))
    return words


def _leading(same: np.ndarray) -> np.ndarray:
    return np.logical_and.accumulate(same, axis=1).sum(axis=1)


def _block_pairs(rows: pa.Table, threshold: float) -> pa.Table:
    """Similar pairs of one cell: a sequence of the first block against all of the second that its length allows."""
    rows = rows.combine_chunks()
    flat = pc.dictionary_encode(pc.list_flatten(rows["signs"])).combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(rows["signs"]).to_numpy())])
    lengths, codes = _padded(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.indices.cast(pa.int64())))
    tokens = len(flat.dictionary)
    order = np.argsort(lengths, kind="stable")
    lengths, codes = lengths[order], codes[order]
    number = rows["seq_no"].to_numpy()[order]
    side = rows["side"].to_numpy()[order]
    one_block = not (side == 1).any()
    left = np.flatnonzero(side == 0)
    right = left if one_block else np.flatnonzero(side == 1)
    sets = _token_sets(codes, tokens)
    back = np.full_like(codes, -1)
    places = np.arange(codes.shape[1])
    inside = places < lengths[:, None]
    back[inside] = np.take_along_axis(codes, np.maximum(lengths[:, None] - 1 - places, 0), 1)[inside]
    r_len, r_codes, r_back, r_sets, r_number = (x[right] for x in (lengths, codes, back, sets, number))
    by_place = np.ascontiguousarray(r_codes.T)
    found: list[tuple] = []
    for i in left:
        n = int(lengths[i])
        lo, hi = np.searchsorted(r_len, -(-3 * n // 8)), np.searchsorted(r_len, 8 * n // 3, "right")
        if lo >= hi:
            continue
        mask = np.zeros(tokens + 1, np.uint64)  # the last one is for places behind the end
        np.bitwise_or.at(mask, codes[i, :n], np.uint64(1) << np.arange(n, dtype=np.uint64))
        full = np.uint64((1 << n) - 1)
        state = np.full(hi - lo, full)
        for at in range(int(r_len[hi - 1])):
            hit = state & mask[by_place[at, lo:hi]]
            state = ((state + hit) | (state - hit)) & full
        lcs = n - np.bitwise_count(state).astype(np.int64)
        m = np.maximum(r_len[lo:hi], n)
        p, q = _leading(r_codes[lo:hi, :n] == codes[i, :n][: r_codes.shape[1]]), _leading(r_back[lo:hi, :n] == back[i, :n])
        both = np.bitwise_count(r_sets[lo:hi] & sets[i]).sum(axis=1, dtype=np.int64)
        j = both / np.bitwise_count(r_sets[lo:hi] | sets[i]).sum(axis=1, dtype=np.int64)
        similarity = 0.4 * (lcs / m) + 0.2 * (p / m) + 0.2 * (q / m) + 0.2 * j
        near = similarity >= threshold
        if one_block:
            near &= r_number[lo:hi] > number[i]
        at = np.flatnonzero(near)
        other = r_number[lo:hi][at]
        found.append((np.minimum(other, number[i]), np.maximum(other, number[i]), similarity[at]))
    kinds = (np.int64, np.int64, np.float64)
    columns = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, kind) for k, kind in enumerate(kinds)]
    return pa.table(dict(zip(("seq_no_a", "seq_no_b", "similarity"), columns, strict=True)))


def in_blocks(types: DataFrame, rows: int, threshold: float = THRESHOLD, pairs_per_task: int = PAIRS_PER_TASK) -> DataFrame:
    """(seq_no_a, seq_no_b, similarity) of all similar pairs, by comparing each block of sequences with each.

    For sequences of up to NATIVE_LCS tokens. A cell has ``pairs_per_task``
    pairs on average, however many sequences there are.
    """
    blocks = max(1, -(-rows // max(1, int(pairs_per_task**0.5))))
    mine = types.where(F.size("signs") > 0).select(
        F.col("seq_no").cast("long").alias("seq_no"), "signs", F.pmod(F.xxhash64("seq_no"), F.lit(blocks)).alias("own")
    )
    each = mine.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    cells = each.select(
        (F.least("own", "other") * blocks + F.greatest("own", "other")).alias("cell"), "seq_no", "signs",
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"),
    )
    # A number that is named: cells are small and their work is not, so tasks must not be put together by their bytes.
    dealt = cells.repartition(min(blocks * (blocks + 1) // 2, 4096), "cell")
    return dealt.groupBy("cell").applyInArrow(
        lambda table: _block_pairs(table, threshold), "seq_no_a long, seq_no_b long, similarity double"
    )


def _dense(seqs: DataFrame, rows: int) -> bool:
    """Whether keys would meet in a good part of all pairs."""
    if rows <= FEW_SEQUENCES:
        return True
    classes = [r[0] for r in seqs.select(_class_of(F.col("len"))).distinct().collect()]
    # A few bytes each, and many keys: dealt out by number.
    dealt = seqs.repartition(4 * seqs.sparkSession.sparkContext.defaultParallelism)
    sizes = _keyed(dealt, sorted(classes)).groupBy(*GROUP).agg(F.count_if("as_short").alias("s"), F.count_if("as_long").alias("l"))
    met = sizes.agg(F.sum(F.col("s").cast("double") * F.col("l"))).first()[0] or 0.0
    return rows * rows / 2 <= PAIRS_PER_MEETING * met


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a one-row generator, below which the optimizer cannot push filters.

    Without it, filters on an expensive column would carry a copy of the
    expression down into the join.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def score(pairs: DataFrame, native: bool, threshold: float = THRESHOLD) -> DataFrame:
    """Exact similarity of (signs_a, signs_b) rows; keeps those at or over the threshold.

    Everything but the LCS is computed first, and pairs that could not pass
    even with LCS = overlap never reach it.
    """
    a, b = F.col("signs_a"), F.col("signs_b")
    m = F.greatest(F.size(a), F.size(b))
    swap = F.size(a) <= F.size(b)
    n, o = F.least(F.size(a), F.size(b)), F.col("overlap")
    jaccard = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    bound = F.lit(0.6) * (o / m) + F.lit(0.2) * jaccard
    near = pairs.where((o == n) | (bound >= threshold - 1e-9))
    cheap = _once(near, p=_same_from(a, b), s=_same_from(F.reverse(a), F.reverse(b)), j=jaccard)

    def total(lcs: Column) -> Column:
        lit = F.lit
        return (
            lit(0.4) * (lcs / m) + lit(0.2) * (F.col("p") / m)
            + lit(0.2) * (F.col("s") / m) + lit(0.2) * F.col("j")
        )

    possible = cheap.where(total(F.col("overlap")) >= threshold - 1e-9)
    short, long = F.when(swap, a).otherwise(b), F.when(swap, b).otherwise(a)
    lcs = lcs_length(short, long) if native else lcs_length_any(short, long)
    scored = _once(possible, lcs=lcs)
    return scored.withColumn("similarity", total(F.col("lcs"))).where(
        F.col("similarity") >= threshold
    )


def similar_pairs(
    types: DataFrame, threshold: float = THRESHOLD, pairs_per_task: int = PAIRS_PER_TASK
) -> DataFrame:
    """All pairs ``seq_no_a < seq_no_b`` of ``types (seq_no, signs)`` at or over the threshold."""
    if threshold < THRESHOLD:
        raise ValueError("the keys are complete only for thresholds of 0.5 and more")
    nulls = F.max(F.exists("signs", lambda t: t.isNull()))
    rows, longest, unknown = types.agg(F.count(F.lit(1)), F.max(F.size("signs")), nulls).first()
    short = (longest or 0) <= NATIVE_LCS and not unknown
    seqs = None if short and rows <= FEW_SEQUENCES else cut(_with_elements(types))
    if short and _dense(seqs, rows):
        texts = types.select("seq_no", "signs")
        return (
            in_blocks(types, rows, threshold, pairs_per_task)
            .join(texts.withColumnsRenamed({"seq_no": "seq_no_a", "signs": "signs_a"}), "seq_no_a")
            .join(texts.withColumnsRenamed({"seq_no": "seq_no_b", "signs": "signs_b"}), "seq_no_b")
            .select("seq_no_a", "seq_no_b", "signs_a", "signs_b", "similarity")
        )
    pairs = cut(candidates(seqs, pairs_per_task))
    bodies = types.select("seq_no", "signs").join(seqs.select("seq_no", "elements"), "seq_no")

    def body(side: str) -> DataFrame:
        return bodies.select(
            F.col("seq_no").alias(f"seq_no_{side}"), F.col("signs").alias(f"signs_{side}"), F.col("elements").alias(f"elements_{side}")
        )

    def scored(some: DataFrame, native: bool) -> DataFrame:
        met = some.join(body("a"), "seq_no_a").join(body("b"), "seq_no_b")
        met = _once(met, overlap=F.size(F.array_intersect("elements_a", "elements_b"))).drop("elements_a", "elements_b")
        return score(met, native, threshold)

    word = F.col("shorter") <= NATIVE_LCS
    return scored(pairs.where(word), True).unionByName(scored(pairs.where(~word), False)).select(
        "seq_no_a", "seq_no_b", "signs_a", "signs_b", "similarity"
    )
