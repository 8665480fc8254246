"""Sequences compared in blocks give the pairs that keys give, and no pair is written before it is judged."""

from __future__ import annotations

import random

import pytest

from linegrain.operators import similarity as sm


def sequences(seed: int, size: int, longest: int, words: int) -> list[list[str]]:
    rng = random.Random(seed)
    made = {tuple(f"w{int(rng.random() ** 2 * words)}" for _ in range(rng.randint(1, longest))) for _ in range(size)}
    return [list(s) for s in sorted(made)]


def pairs_of(frame) -> dict:
    rows = frame.collect()
    found = {(r["seq_no_a"], r["seq_no_b"]): (r["similarity"], r["signs_a"], r["signs_b"]) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize(
    ("seed", "size", "longest", "words", "per_task"),
    [(1, 150, 7, 4, sm.PAIRS_PER_TASK), (2, 120, 9, 100, 400), (3, 80, 60, 3, 900), (4, 1, 3, 2, 1)],
)
def test_blocks_and_keys_find_the_same_pairs(spark, monkeypatch, seed, size, longest, words, per_task):
    rows = list(enumerate(sequences(seed, size, longest, words), 1))
    types = spark.createDataFrame(rows, "seq_no long, signs array<string>")
    blocks = sm.similar_pairs(types, pairs_per_task=per_task)
    assert "FlatMapGroupsInArrow" in blocks._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(sm, "FEW_SEQUENCES", 0)
    monkeypatch.setattr(sm, "PAIRS_PER_MEETING", 0)
    keys = sm.similar_pairs(types)
    assert "FlatMapGroupsInArrow" not in keys._jdf.queryExecution().optimizedPlan().toString()
    assert pairs_of(blocks) == pairs_of(keys)


def test_sparse_sequences_go_by_keys(spark, monkeypatch):
    """Where few pairs share anything, blocks would compare pairs that no key brings together."""
    monkeypatch.setattr(sm, "FEW_SEQUENCES", 0)
    sparse = spark.createDataFrame([(i, [f"a{i}", f"b{i}", f"c{i // 2}"]) for i in range(200)], "seq_no long, signs array<string>")
    dense = spark.createDataFrame([(i, [f"a{i % 3}", f"b{i % 2}", f"c{i % 5}", "d"]) for i in range(60)], "seq_no long, signs array<string>")
    assert [sm._dense(sm._with_elements(x), n) for x, n in ((sparse, 200), (dense, 60))] == [False, True]
