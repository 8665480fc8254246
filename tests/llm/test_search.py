"""Nearest neighbours and repeat removal against brute force, and the pipeline's stages."""

from __future__ import annotations

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linegrain.llm import hnsw, queries, repeats
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def exact(rows, k, every):
    ids = np.array([-1 if i is None else i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for i, (q, _) in enumerate(rows):
        if q is not None and q % every == 0:
            score = x @ x[i]
            order = np.lexsort((np.where(ids < 0, 1 << 60, ids), -score))
            out[q] = [(rows[j][0], score[j]) for j in order if ids[j] != q][:k]
    return out


def test_search_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = exact(rows, 20, 20)
    got: dict = {}
    for r in queries.op1_sharded_hnsw(spark, SF).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))


def test_search_edge_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(1_000 + i, rows[7][1]) for i in range(60)] + [(None, rows[8][1]), (40, rows[40][1])]
    odd = [(2_000, None), (2_020, [0.0] * 8), (2_040, [1.0, None] + [0.0] * 6), (2_060, [float("nan")] * 8), (2_080, [1.0]), (2_100, [])]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").selectExpr("*", "1 AS shard", "2 AS node")
    want = exact(rows, 5, 20)
    got: dict = {}
    for r in hnsw.nearest(table, k=5, shard=100).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]], q
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]])
    assert hnsw.nearest(table.limit(0)).count() == 0


def test_search_own_rows_take_no_place(spark):
    """Ids with many equal rows, with many vectors, and with both still get k others, each row once."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8)) for i in range(1, 400)]
    rows += [(40, rows[39][1])] + [(60, rows[59][1])] * 30 + [(1_001, rows[79][1])] * 3
    rows += [(100, rows[99][1] + rng.normal(size=8) * 1e-3) for _ in range(25)]
    rows += [(500, rng.normal(size=8)) for _ in range(300)] + [(520, rows[59][1])] * 2
    table = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in hnsw.nearest(table, k=5, shard=200).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    assert got.keys() == {int(i) for i in ids if i % 20 == 0}
    for q, found in got.items():
        score = (x @ x[ids == q].T).max(axis=1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:5]
        assert [r.rank for r in found] == [1, 2, 3, 4, 5], q
        assert [r.vec_id for r in found] == ids[order].tolist(), q
        assert np.allclose([r.score for r in found], score[order])


def check_repeats(found, docs):
    texts = [(t or "").encode() for _, t in docs]
    want = []
    for (d, _), text, gone in zip(docs, texts, brute.repeats(texts), strict=True):
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        spans = sum(1 for k, _ in itertools.groupby(gone) if k)
        want.append((d, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    assert sorted(map(repr, found)) == sorted(map(repr, want))


def test_repeat_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = queries.op4_repeat_removal(spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    check_repeats([tuple(r) for r in found.collect()], docs)


def test_repeat_tables_on_disk(spark, monkeypatch):
    """What grows with the text is not kept: neither all anchors nor the cells of all items."""
    kept = []
    plain = repeats.pinned
    monkeypatch.setattr(repeats, "pinned", lambda df, name: kept.append(name) or plain(df, name))
    docs = spark.createDataFrame([(i, f"{i} " + "a passage that stands in both texts " * 9) for i in range(2)], "doc_id long, text string")
    assert repeats.remove_repeats(docs, carry=["doc_id"]).where("n_removed > 0").count() == 2
    assert not {"repeat-anchors", "repeat-cells-8"} & set(kept)


def test_repeat_edge_rows(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared, long = word(230), word(2_500)
    docs = [(d, t) for d, t, _, _ in brute.EDGE if len(t or "") < 20_000]
    docs += [(20 + i, word(i) + shared + word(50)) for i in range(6)]
    docs += [(30, long), (31, long[:700] + "#" + long[700:1_500] + word(10) + long[1_400:]), (32, long[300:499]), (33, long)]
    docs += [(34, "x" * 201), (35, "y" * 200), (36, "z" * 199), (37, word(300))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("anchor", F.lit("clash")).repartition(3)
    found = repeats.remove_repeats(frame, carry=["doc_id"]).select("_row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    check_repeats([tuple(r) for r in found.collect()], docs)
    kept = repeats.without_repeats(frame)
    assert kept.columns == frame.columns
    assert kept.count() == len(docs)
    assert repeats.remove_repeats(frame.limit(0)).count() == 0


def test_long_text_in_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    text = rng.integers(97, 101, 9_000).astype(np.uint8)
    whole = repeats._items(text, np.array([0, len(text)]))
    monkeypatch.setattr(repeats, "STEP_BYTES", 1_000)
    cut = []
    for data, bounds, before in repeats._pieces(text, np.array([0, len(text)])):
        found = repeats._items(data, bounds)
        cut += [set(range(a - h + before[0], a - lo + before[0] + 1)) for a, lo, h in zip(found["anchor"], found["low"], found["high"], strict=True)]
    places = [p for x in cut for p in x]
    assert sorted(places) == list(range(len(text) - repeats.SIZE + 1))
    assert sum(whole["high"] - whole["low"] + 1) == len(places)


@pytest.fixture(scope="module")
def staged(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.cache()]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def test_stages(spark, staged):
    first, good, single, cut, mixed, packed = staged
    for x in (good, single, cut, mixed):
        assert x.columns == first.columns
    rows = {r.doc_id: r.text for r in good.collect()}
    assert all(not brute.quality_counts(t)[-1] for t in rows.values())
    near = brute.near_components(list(rows.items()), 5)
    left = {r.doc_id: r.text for r in single.collect()}
    assert sorted(left) == sorted({c for _, c in near.values()})
    after = {r.doc_id: r.text for r in cut.collect()}
    ids = list(left)
    for d, gone in zip(ids, brute.repeats([left[d].encode() for d in ids]), strict=True):
        kept = bytes(b for b, g in zip(left[d].encode(), gone, strict=True) if not g)
        assert len(kept) <= len(after[d].encode()) <= len(kept) + 4 * sum(gone) and (any(gone) or after[d] == left[d])
    words = {}
    for r in mixed.collect():
        assert r.text and after[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
        words[r.source] = words.get(r.source, 0) + len(brute.WORD.findall(r.text))
    sizes: dict = {}
    for r in cut.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(brute.WORD.findall(r.text))
    for s, target in brute.mix_targets(sizes).items():
        assert abs(words.get(s, 0) - target) <= 1
    fill: dict = {}
    for r in packed.collect():
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 4096 and len(fill) <= -(-sum(fill.values()) // 4096) * 1.02 + 1
