"""A prefix trie of conversations, from vertical bitmaps of turns by shard.

Conversations are numbered in order of their ids and dealt into shards of
``SHARD`` consecutive numbers. Inside a shard every (position, turn) has a
bitset with a bit for each conversation that has that turn there. A depth-first
walk starts from all conversations of the shard: the members of a child are the
members of its parent AND the bitset of (position, turn), its size is their
popcount, and the members that no bitset of the position holds end at the
parent. A node is known across shards by a digest chained over its turns.

Shards are merged by digest. What a node adds to its ancestors is counted in
one shard only, the one of its smallest member, where all its ancestors are
nodes too; so sums over subtrees are sums inside shards, added up by digest.
Bytes of a conversation's ids are hashed in order, row by row, since SHA-256
has no parallel form; a node of very many conversations has one row per shard.

Turns go to a shard as digests and word counts, never as text, so very long
texts cost nothing there. Equal turn numbers are ordered by role and text, NULL
numbers come first, NULL role and text are empty, repeated rows are turns of
their own. Rows with a NULL conv_id belong to no conversation and are left out.
A table without conversations gives no rows; further columns are not read.
A shard's memory grows with the turns of its ``SHARD`` conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linegrain.llm.common import n_words, pinned
from linegrain.scale import ordered_index

SHARD = 2048
#: Conversations that share their first turns, and how many turns they may share.
FAMILY, SHARED = 20, 4
ROOT = hashlib.sha256(b"").digest()[:16]
NOTHING = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, words): the turns of every conversation in order, from position 0."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    framed = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    slim = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.sha2(framed, 256).alias("digest"), n_words(text).alias("words"),
        role.alias("_role"), F.sha2(text, 256).alias("_text"),
    )
    # Rows that tie in turn, role and text are equal; among different texts of one turn and role the digest decides.
    place = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "_role", "_text"))
    return slim.select("conv_id", (place - 1).alias("pos"), F.unhex(F.substring("digest", 1, 32)).alias("digest"), "words")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conversation ids, and the turns of each after it has taken over its family's first ones."""
    head = F.crc32(F.col("conv_id").cast("string")) % SHARED
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    ids = own.select("conv_id").distinct()
    kept = own.where(F.col("pos") >= head)
    first = own.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < SHARED - 1))
    # At most 39 ids of a family meet at most three turns.
    heirs = ids.select(F.col("conv_id").alias("_heir"), family.alias("conv_id"), head.alias("_head"))
    taken = first.join(heirs, "conv_id").where(F.col("pos") < F.col("_head"))
    taken = taken.select(F.col("_heir").alias("conv_id"), "pos", "digest", "words")
    return ids, kept.unionByName(taken)


def _bits(numbers: np.ndarray) -> int:
    flags = np.zeros(int(numbers.max()) + 1, np.uint8)
    flags[numbers] = 1
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def _members(bits: int) -> np.ndarray:
    raw = np.frombuffer(bits.to_bytes((bits.bit_length() + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little"))


_WALKED = (
    "shard long, at int, up int, key binary, depth long, n long, low long, words long, ends array<long>"
)


def _walk(rows: pd.DataFrame, size: int) -> pd.DataFrame:
    """The nodes of one shard in depth-first order; ``at`` numbers them and ``up`` is the parent's number."""
    shard = int(rows["shard"].iloc[0])
    bit = (rows["number"] % size).to_numpy(np.int64)
    ids = np.zeros(size, np.int64)
    ids[bit] = rows["conv_id"].to_numpy(np.int64)
    everyone = _bits(np.unique(bit))
    seen = rows["pos"].notna().to_numpy()
    here = rows[seen]
    here_bit, pos, words = bit[seen], here["pos"].to_numpy(np.int64, copy=True), here["words"].to_numpy(np.int64)
    # A family that lacks turns leaves a gap before a conversation's own ones: positions count what is there.
    by_bit = np.lexsort((pos, here_bit))
    new = np.r_[True, np.diff(here_bit[by_bit]) != 0][: len(pos)]
    pos[by_bit] = np.arange(len(pos)) - np.maximum.accumulate(np.where(new, np.arange(len(pos)), 0))
    digests = here["digest"].to_numpy()
    turn = pd.factorize(pd.Series(digests, dtype=object))[0]
    said: dict[tuple[int, int], int] = {}
    postings: dict[tuple[int, int], int] = {}
    speaking: dict[int, int] = {}
    order = np.lexsort((here_bit, turn, pos))
    starts = np.flatnonzero(np.r_[True, (np.diff(pos[order]) != 0) | (np.diff(turn[order]) != 0)]) if len(order) else []
    example: dict[tuple[int, int], int] = {}
    for some in np.split(order, starts[1:]) if len(order) else []:
        key = int(pos[some[0]]), int(turn[some[0]])
        postings[key] = _bits(here_bit[some])
        speaking[key[0]] = speaking.get(key[0], 0) | postings[key]
        example[key] = int(some[0])
    for p, t, b in zip(pos.tolist(), turn.tolist(), here_bit.tolist(), strict=True):
        said[b, p] = t
    found: list[tuple] = []
    stack = [(everyone, 0, ROOT, -1, 0)]
    while stack:
        members, depth, key, up, n_words_here = stack.pop()
        at = len(found)
        going = members & speaking.get(depth, 0)
        ends = ids[_members(members ^ going)] if members != going else np.zeros(0, np.int64)
        lowest = (members & -members).bit_length() - 1
        found.append((shard, at, up, key, depth, members.bit_count(), int(ids[lowest]), n_words_here, ends))
        while going:
            first = (going & -going).bit_length() - 1
            spot = depth, said[first, depth]
            child = members & postings[spot]
            there = example[spot]
            stack.append((child, depth + 1, hashlib.sha256(key + digests[there]).digest()[:16], at, int(words[there])))
            going &= ~child
    return pd.DataFrame(found, columns=[c.split()[0] for c in _WALKED.split(", ")])


_SUMMED = (
    "key binary, shard long, depth long, n_convs long, conv_id long, parent_conv_id long, "
    "n_children long, n_leaves long, saved_tokens long, ends array<long>"
)


def _sum_up(rows: pd.DataFrame) -> pd.DataFrame:
    """A shard's part of every sum over a subtree.

    A node counts where its smallest member is, and there for all its
    ancestors; in depth-first order a node's number is above its parent's.
    """
    rows = rows.sort_values("at", ignore_index=True)
    up = rows["up"].to_numpy(np.int64)
    mine = rows["low"].to_numpy() == rows["conv_id"].to_numpy()
    leaves = (mine & (rows["n_ends"].to_numpy() == rows["n_convs"].to_numpy())).astype(np.int64)
    saved = np.where(mine, (rows["n_convs"].to_numpy() - 1) * rows["words"].to_numpy(), 0).astype(np.int64)
    children = np.zeros(len(rows), np.int64)
    inner = up >= 0
    np.add.at(children, up[inner & mine], 1)
    below, gain = leaves.tolist(), saved.tolist()
    for at in range(len(up) - 1, 0, -1):
        above = up[at]
        below[above] += below[at]
        gain[above] += gain[at]
    parents = rows["conv_id"].to_numpy()[np.maximum(up, 0)]
    return pd.DataFrame(
        {
            "key": rows["key"], "shard": rows["shard"], "depth": rows["depth"], "n_convs": rows["n_convs"], "conv_id": rows["conv_id"],
            "parent_conv_id": pd.Series(parents, dtype="Int64").mask(~(inner & mine)), "n_children": children,
            "n_leaves": below, "saved_tokens": gain, "ends": rows["ends"],
        }
    )


_NODE = pa.schema(
    [
        ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
        ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()),
    ]
)
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each key; the rows of a key come together and in order of shards, which is that of ids."""
    key = node = None
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if row["key"] != key:
                if node is not None:
                    done.append(node | {"ends_sha256": digest.hexdigest()})
                key, digest, some = row["key"], hashlib.sha256(), False
                node = {c: row[c] for c in ("conv_id", "depth", "n_convs")}
                node |= {"parent_conv_id": None, "n_children": 0, "n_leaves": 0, "saved_tokens": 0}
            if row["parent_conv_id"] is not None:
                node["parent_conv_id"] = row["parent_conv_id"]
            for c in ("n_children", "n_leaves", "saved_tokens"):
                node[c] += row[c]
            if row["ends"]:
                digest.update((("," if some else "") + ",".join(map(str, row["ends"]))).encode())
                some = True
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=_NODE)
    if node is not None:
        yield pa.RecordBatch.from_pylist([node | {"ends_sha256": digest.hexdigest()}], schema=_NODE)


def prefix_nodes(ids: DataFrame, spoken: DataFrame, size: int = SHARD) -> DataFrame:
    """The nodes of the trie of ``spoken (conv_id, pos, digest, words)`` for all conversations ``ids (conv_id)``."""
    numbers = pinned(ordered_index(ids, ["conv_id"], "number"), "trie-numbers").withColumn("number", F.col("number") - 1)
    dealt = numbers.join(spoken, "conv_id", "left").withColumn("shard", F.floor(F.col("number") / size).cast("long"))
    walked = pinned(dealt.groupBy("shard").applyInPandas(lambda rows: _walk(rows, size), _WALKED), "trie-shards")
    merged = walked.groupBy("key").agg(
        F.sum("n").alias("n_convs"), F.min("low").alias("conv_id"), F.sum(F.size("ends")).cast("long").alias("n_ends")
    )
    back = walked.drop("n").join(merged, "key")
    summed = back.groupBy("shard").applyInPandas(_sum_up, _SUMMED)
    return summed.repartition("key").sortWithinPartitions("key", "shard").mapInArrow(_merge, NODE)


def conversation_trie(conversations: DataFrame, size: int = SHARD) -> DataFrame:
    """A row for each distinct sequence of first turns of the rebuilt conversations."""
    own = pinned(turns(conversations), "trie-turns")
    return prefix_nodes(*rebuilt(own), size)


def trie_of(conversations: DataFrame, size: int = SHARD) -> DataFrame:
    """The same of the conversations as they are."""
    own = pinned(turns(conversations), "trie-turns")
    return prefix_nodes(own.select("conv_id").distinct(), own, size)
