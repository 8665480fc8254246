"""Encoding with shared chunks against the plain tokenizer."""

from __future__ import annotations

import hashlib
import random
from functools import lru_cache

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linegrain.llm import queries, reuse
from linegrain.llm.tokens import encoder
from tests.llm import brute


@lru_cache
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(reuse.VOCABULARY))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain(text):
    ids = library().encode(text or "", add_special_tokens=False).ids
    decoded = library().decode(ids, skip_special_tokens=False)
    return len(ids), sha(" ".join(map(str, ids))), sha(decoded), ids, decoded


def test_edge_rows(spark):
    """NULLs, ties, repeated rows, long texts, one hot text, passages that start inside words, and odd characters."""
    rng = random.Random(5)
    passage = " ".join(rng.choice(["naïve", "don't", "Straße", "x1y2", "#tag", "<|endoftext|>", "漢字", "ﬁne", "éa"]) for _ in range(600))
    rows = [(i, t) for i, t, _, _ in brute.EDGE]
    rows += [(100 + i, f"lead{i}" + passage[i * 7 :] + f"tail{i}") for i in range(30)] + [(200 + i, passage) for i in range(40)]
    rows += [(300, "ab" * 300_000), (301, passage.replace(" ", "")), (302, " " * 5_000 + passage + "\n" * 3_000), (303, passage + passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("_key", F.lit(1)).repartition(4)
    found = reuse.encode_decode(docs, whole=True, bits=6).collect()
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, list(r.ids), r.decoded) for r in found), key=repr)
    assert got == sorted(((i, *plain(t)) for i, t in rows), key=repr)
    assert reuse.encode_decode(docs.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["ab", " ", "é", "'s", "\n", "<|endoftext|>", "Z9", "漢", "é", " the cat", "."]), max_size=60).map("".join), st.data())
def test_joins_of_any_chunks(text, data):
    """Whatever chunks a text is given, its ids are those of the tokenizer."""
    places = sorted(data.draw(st.sets(st.integers(0, len(text)), max_size=6)))
    own = encoder(reuse.VOCABULARY)
    parts = []
    for a, b in zip(places, places[1:], strict=False):
        start, chunk = len(text[:a].encode()), text[a:b]
        parts.append((start, len(chunk.encode()), own.encode(chunk)))
    (ids,) = reuse.joined([text], [parts + parts[:1]], own)
    assert ids.tolist() == plain(text)[3]


def test_wrong_ids_are_noticed():
    """Ids that do not agree with the text are dropped."""
    text = " ".join(f"word{i}" for i in range(40))
    own = encoder(reuse.VOCABULARY)
    chunk = own.encode(text[3:200])
    chunk[2:4] = 7  # the first whole word
    (ids,) = reuse.joined([text], [[(3, 197, chunk)]], own)
    assert ids.tolist() == plain(text)[3]


def test_cuts_move_with_the_content():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 123, 3 << 20).astype(np.uint8)
    one, two = reuse.cut_points(data, 8), reuse.cut_points(np.concatenate([data[:77], data]), 8)
    assert one[-1] == len(data) and len(np.setdiff1d(one + 77, two)) <= 1
    assert 150 < np.diff(one).mean() < 400


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = queries.op11_chunk_reuse(spark, folder).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == sorted((i, *plain(t)[:3]) for i, t in texts.items())


def test_texts_are_shuffled_once_and_packed(spark, tmp_path, monkeypatch):
    """Texts are compressed before their one shuffle, and come back whole."""
    rng = random.Random(8)
    passage = " ".join(rng.choice(["one", "naïve", "x1y2", "漢字", "words"]) for _ in range(3000))
    texts = ["", "a", "é漢 " * 5000, "x" * (reuse.STEP_BYTES + 5), "first " + passage, passage + " last"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    keyed = docs.select(F.unhex(F.md5("text")).alias("_key"), F.col("text").alias("_text"))
    back = keyed.mapInArrow(reuse._pack, reuse.PACKED).mapInArrow(reuse._unpacked, "_key binary, _text string")
    assert sorted(r["_text"] for r in back.collect()) == sorted(texts)
    plans, kept = [], reuse.pinned

    def pinned(df, name):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, name)

    monkeypatch.setattr(reuse, "pinned", pinned)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = reuse.encode_decode(docs).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r["doc_id"]: r["n_tokens"] for r in found} == {i: plain(t)[0] for i, t in enumerate(texts)}
    final = plans[-1].split("== Initial Plan ==")[0]
    grouped = [x for x in final.splitlines() if "SortAggregate(key=[_key" in x]
    assert grouped and all("_packed" in x and "_text" not in x for x in grouped), grouped
    assert "ReusedExchange" in final
