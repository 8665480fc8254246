"""Near-duplicates and packing against plain versions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from linegrain.llm import neardup, packing, queries
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(brute.EDGE, brute.DOCS).withColumn("cls", F.lit("clash")).withColumn("_row", F.lit(1))


def test_near_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = brute.near_components([(r.doc_id, r.text) for r in docs])
    for r in queries.op7_minhash_components(spark, SF).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], r.doc_id == want[r.doc_id][1])


def drifting(n: int, words: int, seed: int) -> list[tuple[int, str]]:
    """Copies of copies: neighbours are similar, ends are not; beside them texts that share a line."""
    rng = random.Random(seed)
    line = " ".join(f"shared{i}" for i in range(12))
    text = [f"v{rng.randrange(10_000)}" for _ in range(words)]
    out = []
    for i in range(n):
        text[rng.randrange(words)] = f"e{i}"
        out.append((i, " ".join(text)))
        out.append((n + i, line + " " + " ".join(f"u{rng.randrange(100_000)}" for _ in range(6))))
    return out


@pytest.mark.parametrize(("short", "limit"), [(1, 0), (4, 1_000_000)])
def test_near_chain_and_shared_line(spark, monkeypatch, short, limit):
    monkeypatch.setattr(neardup, "SHORT", short)  # stars first, or all pairs at once
    monkeypatch.setattr(neardup, "PAIRS_PER_POSTING", limit)
    docs = drifting(60, 60, 3)
    want = brute.near_components(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame, shingle=2).collect()}
    assert found == want


def edited(n: int, words: int, seed: int) -> list[tuple[int, str]]:
    """Copies of one text with one to fifteen edits of their own, some copied once more."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    out = []
    for i in range(n):
        text = list(base if i % 4 else out[-1][1].split() if out else base)
        for _ in range(rng.randrange(1, 16)):
            text[rng.randrange(words)] = f"e{rng.randrange(300)}"
        out.append((i, " ".join(text)))
    return out


@pytest.mark.parametrize("exact", [False, True])
def test_near_group_of_edited_copies(spark, monkeypatch, exact):
    monkeypatch.setattr(neardup, "PAIRS_PER_POSTING", 1_000_000)  # full sets after one turn of stars
    docs = edited(150, 100, 5) + [(1_000 + i, t) for i, t in drifting(30, 60, 3)]
    want = brute.near_components(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = {
        r.doc_id: (r.n_shingles, r.component_id)
        for r in neardup.near_duplicates(frame, shingle=2, exact=exact).collect()
    }
    assert found == want
    assert 1 < len({c for i, (_, c) in want.items() if i < 1_000}) < 150


def test_near_edge_rows(spark, edge):
    found = neardup.near_duplicates(edge).collect()
    assert len(found) == len(brute.EDGE)
    by = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr)
    assert (4, 0, 4) in by and (3, 0, 3) in by and (None, 1, None) in by and (7, 1, 7) in by
    kept = neardup.deduplicated(edge.unionByName(edge))
    assert kept.columns == edge.columns
    texts = [r.text for r in kept.collect()]
    assert len([t for t in texts if t and t.strip()]) == len({t for _, t, _, _ in brute.EDGE if t and t.strip()})
    assert neardup.near_duplicates(edge.limit(0)).count() == 0


def check_packing(rows, docs):
    plain = brute.tokens("word_bpe_49k.json")
    want = []
    for d, text in docs:
        ids = [*plain(text), 1]
        want += [(d, i // 4096, i, len(ids[i : i + 4096]), brute.crc(ids[i : i + 4096])) for i in range(0, len(ids), 4096)]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == sorted(want, key=repr)
    bins: dict = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 4096
    return len(bins), -(-sum(w[3] for w in want) // 4096)


def test_packing_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    used, least = check_packing(queries.op3_genetic_packing(spark, SF).collect(), docs)
    assert used <= least * 1.01 + 1


def test_packing_edge_rows(spark, edge):
    check_packing(packing.pack_documents(edge).collect(), [(d, t) for d, t, _, _ in brute.EDGE])
    assert packing.pack_documents(edge.limit(0)).count() == 0


def test_levels_of_shards(spark):
    rng = random.Random(5)
    items = [(i, rng.randrange(1, 90)) for i in range(3_000)] + [(10_000 + i, 2) for i in range(2_000)]
    frame = spark.createDataFrame(items, "pid long, length long")
    found = packing.pack(frame, capacity=100, shard=150).collect()
    assert len(found) == len(items)
    fill: dict = {}
    size = dict(items)
    for r in found:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + size[r.pid]
    assert max(fill.values()) <= 100
    assert len(fill) <= 1.05 * sum(size.values()) / 100


def test_genetic_steps_beat_best_fit():
    rng = random.Random(1)
    worse = 0
    for seed in range(4):
        lengths = sorted((rng.randrange(700, 2200) for _ in range(200)), reverse=True)
        first = packing._Packing(lengths, 4096)
        first.best_fit(list(range(200)))
        grown = packing.evolve(lengths, 4096, [seed], people=6, children=60)
        assert sorted(i for x in grown.bins.values() for i in x) == list(range(200))
        worse += len(grown.bins) > len(first.bins)
    assert not worse
