"""Trie nodes against sets of plain tuples."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from linegrain.llm import queries, trie

KIND = "conv_id long, turn long, role string, text string"
NAMES = [x.split()[0] for x in trie.NODE.split(", ")]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def told(rows):
    made = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            made[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in made.items()}


def retold(made):
    out = {}
    for c, own in made.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = made.get(c - c % 20, [])[:h] + own[h:]
    return out


def nodes(made):
    members = defaultdict(list)
    for c, said in made.items():
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append(c)
    out = []
    for key, convs in members.items():
        below = [k for k in members if k[: len(key)] == key]
        kids = {k for k in below if len(k) == len(key) + 1}
        leaves = [k for k in below if not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in below)]
        saved = sum((len(members[k]) - 1) * (len(WORD.findall(k[-1][1])) if k else 0) for k in below)
        ends = sorted(c for c in convs if len(made[c]) == len(key))
        parent = min(members[key[:-1]]) if key else None
        out.append((min(convs), len(key), parent, len(convs), len(kids), len(leaves), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def rows_of(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=repr)


EDGE = [
    (0, 0, "user", "hello there"), (0, 1, "bot", "how are you"), (0, None, "sys", None), (0, 1, "bot", "how are you"),
    (1, 0, "user", "hello there"), (1, 1, None, ""), (2, 5, "user", "x " * 50_000), (3, None, None, None), (3, None, None, None),
    (19, 1, "user", "only one"), (25, 0, "user", "no family"), (25, 1, "bot", "b"), (25, 2, "user", "c"), (25, 3, "bot", "d"),
    (40, 0, "user", "short family"), (41, 0, "user", "a"), (41, 1, "bot", "b"), (41, 2, "user", "c"), (41, 3, "bot", "d"),
    (42, 0, "user", "a"), (43, 0, "a", "ab"), (44, 0, "aa", "b"), (None, 0, "user", "nobody"), (None, None, None, None),
]
EDGE += [(c, 0, "user", "one common turn") for c in range(1000, 1100)] + [(9_000_000_000, i, "user", f"t{i}") for i in range(300)]


@pytest.mark.parametrize("size", [2048, 8])
def test_edge_rows(spark, size):
    """NULLs, ties, gaps, a short and an absent family, long texts and depth, one shard and many."""
    df = spark.createDataFrame(EDGE, KIND).withColumn("pos", F.lit("clash")).withColumn("shard", F.lit(1)).repartition(5)
    assert rows_of(trie.conversation_trie(df, size)) == sorted(nodes(retold(told(EDGE))), key=repr)
    assert rows_of(trie.trie_of(df, size)) == sorted(nodes(told(EDGE)), key=repr)


def test_no_rows(spark):
    none = spark.createDataFrame([], KIND)
    assert trie.conversation_trie(none).count() == 0
    assert trie.conversation_trie(spark.createDataFrame([(None, 1, "a", "b")], KIND)).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(queries.op13_prefix_trie(spark, folder)) == sorted(nodes(retold(told(rows))), key=repr)
