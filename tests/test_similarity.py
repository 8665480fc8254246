"""The blocked join against all pairs, and components against a plain search."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from linegrain.operators import components as cc
from linegrain.operators import similarity as sm


def plain_similarity(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    m, n = max(len(a), len(b)), min(len(a), len(b))
    p = next((i for i in range(n) if a[i] != b[i]), n)
    s = next((i for i in range(n) if a[-1 - i] != b[-1 - i]), n)
    j = len(set(a) & set(b)) / len(set(a) | set(b))
    return 0.4 * (table[-1][-1] / m) + 0.2 * (p / m) + 0.2 * (s / m) + 0.2 * j


def corpus(seed, size, longest, words):
    rng = random.Random(seed)
    seen = set()
    while len(seen) < size:
        if seen and rng.random() < 0.5:
            base = list(rng.choice(sorted(seen)))
            for _ in range(rng.randint(1, 1 + len(base) // 3)):
                at = rng.randrange(len(base) + 1)
                if rng.random() < 0.5:
                    base.insert(at, f"w{rng.randrange(words)}")
                elif len(base) > 1:
                    base.pop(at % len(base))
        else:
            base = [f"w{int(rng.paretovariate(1)) % words}" for _ in range(rng.randint(1, longest))]
        seen.add(tuple(base))
    return sorted(seen)


@pytest.mark.parametrize(
    ("seed", "size", "longest", "words", "per_task"),
    [
        (1, 160, 6, 5, sm.PAIRS_PER_TASK),
        (2, 160, 12, 30, sm.PAIRS_PER_TASK),
        (3, 120, 40, 12, 50),
        (4, 60, 90, 200, sm.PAIRS_PER_TASK),
    ],
)
def test_no_pair_is_missed(spark, seed, size, longest, words, per_task):
    seqs = corpus(seed, size, longest, words)
    types = spark.createDataFrame(
        [(i, list(s)) for i, s in enumerate(seqs)], "seq_no long, signs array<string>"
    )
    got = sm.similar_pairs(types, pairs_per_task=per_task).collect()
    found = {(r["seq_no_a"], r["seq_no_b"]): r["similarity"] for r in got}
    assert len(found) == len(got)
    want = {}
    for (i, a), (j, b) in itertools.combinations(enumerate(seqs), 2):
        value = plain_similarity(a, b)
        if value >= 0.5:
            want[i, j] = value
    assert found == want
    assert want


def test_long_sequences(spark):
    """200 sequences of 3,000 tokens; the index holds no arrays."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(20_000)]
    seqs = []
    for i in range(200):
        base = [rng.choice(words) for _ in range(3_000)] if i % 4 == 0 else list(seqs[-1])
        if i % 4:
            for _ in range((0, 20, 400, 2_000)[i % 4]):
                base[rng.randrange(3_000)] = rng.choice(words)
        seqs.append(base)
    types = spark.createDataFrame(list(enumerate(seqs)), "seq_no long, signs array<string>")
    got = {(r["seq_no_a"], r["seq_no_b"]): r["similarity"] for r in sm.similar_pairs(types).collect()}
    want = {}
    for (i, a), (j, b) in itertools.combinations(enumerate(seqs), 2):
        if i // 4 == j // 4:  # others share too few tokens
            masks = {}
            for k, t in enumerate(a):
                masks[t] = masks.get(t, 0) | (1 << k)
            full = state = (1 << len(a)) - 1
            for t in b:
                u = state & masks.get(t, 0)
                state = ((state + u) | (state - u)) & full
            p = next((k for k in range(3_000) if a[k] != b[k]), 3_000)
            s = next((k for k in range(3_000) if a[-1 - k] != b[-1 - k]), 3_000)
            jac = len(set(a) & set(b)) / len(set(a) | set(b))
            value = 0.4 * ((3_000 - state.bit_count()) / 3_000) + 0.2 * (p / 3_000) + 0.2 * (s / 3_000) + 0.2 * jac
            if value >= 0.5:
                want[i, j] = value
    assert got == want
    assert 100 < len(want) < 200
    index = sm._keyed(sm._with_elements(types), [1])
    assert not [f for f in index.schema.fields if f.dataType.typeName() == "array"]


@pytest.mark.parametrize(
    ("a", "b", "value"),
    [
        ("[?] [?]", "[?] [?] [?]", 0.733333),
        ("AB73 [?]", "AB73 [?] [?]", 0.666667),
        ("DA RE", "DA RE KU[", 0.533333),
        ("KU PA3 NU", "]KU PA3 NU", 0.5),
        ("AB24 AB73 AB06", "AB81 AB73 AB06", 0.5),
    ],
)
def test_published_edges(spark, a, b, value):
    types = spark.createDataFrame([(1, a.split()), (2, b.split())], "seq_no long, signs array<string>")
    assert round(sm.similar_pairs(types).first()["similarity"], 6) == value


def test_components_of_chains_hubs_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, i) for i in range(101, 140)]
    edges += [(200, 201), (201, 202), (202, 200), (300, 300), (99, 139)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r["node"]: r["root"] for r in cc.components(df).collect()}
    want = {i: 1 for i in range(1, 31)} | {i: 99 for i in [99, *range(100, 140)]}
    assert got == want | {200: 200, 201: 200, 202: 200}


def test_lcs_functions_agree(spark):
    seqs = corpus(9, 30, 10, 4)
    rows = [(list(a), list(b)) for a in seqs for b in seqs if len(a) <= len(b)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    got = df.select(
        sm.lcs_length(F.col("a"), F.col("b")).alias("x"), sm.lcs_length_any("a", "b").alias("y")
    )
    assert got.where("x <> y").count() == 0
