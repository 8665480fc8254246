"""Quality rules, mixing and token files against plain versions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linegrain.llm import common, mixing, quality, queries, tokenfile
from linegrain.llm.tokens import Encoder, encoder
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(brute.EDGE, brute.DOCS).withColumn("size", F.lit("clash")).withColumn("_row", F.lit(1))


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_quality_counts(spark, edge):
    found = quality.judge(quality.measure(edge, carry=["doc_id", "text", "lang"]), F.col("_row.lang"))
    found = found.select("_row.doc_id", "_row.text", "*")
    for r in found.collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == brute.quality_counts(r.text), r.doc_id
        assert not (r.base_failed and r.kept)
    kept = quality.keep_good(edge)
    assert kept.columns == edge.columns
    assert {r.doc_id for r in kept.collect()} == {8}
    assert quality.keep_good(edge.limit(0)).count() == 0


def test_quality_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = queries.op9_fertility_rules(spark, SF).collect()
    assert len(found) == len(texts)
    for r in found:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == brute.quality_counts(texts[r.doc_id])
    assert sum(r.kept for r in found) > 0.8 * sum(not r.base_failed for r in found)


def test_symbol_text_is_rejected(spark):
    plain = " ".join(f"some{i} words{i} follow" for i in range(60))
    junk = " ".join(f"some{i}*** words{i}%%% follow###" for i in range(60))
    docs = spark.createDataFrame([(1, plain, "en"), (2, junk, "en")], "doc_id long, text string, lang string")
    assert [r.doc_id for r in quality.keep_good(docs).collect()] == [1]


def test_clean_short_texts_stay(spark):
    """One secret or two phone numbers in a short text do not make it bad; junk of that length still is."""
    plain = (
        "La mairie a voté pour la réparation du vieux pont avant l'hiver et le travail va commencer en mai. Il y a des gens qui en "
        "ont parlé, car ce pont est bien vieux et on y va peu. Une école sera aussi bâtie près de la place, où les enfants iront à pied."
    )
    secret = plain + ' token = "' + "a0a87830ca013d94f8f272b52b22" * 4 + '"'
    phone = plain + "".join(f" +1 (528) 555-34{i}" for i in range(34, 39))
    junk = " ".join(f"x{i}q!! z{i}!!" for i in range(30))
    docs = spark.createDataFrame([(1, plain, "fr"), (2, secret, "fr"), (3, phone, "fr"), (4, junk, "fr")], "doc_id long, text string, lang string")
    judged = {r._row.doc_id: r for r in quality.judge(quality.measure(docs), F.col("_row.lang")).collect()}
    assert not any(r.base_failed for r in judged.values())
    assert min(judged[i].chars_per_token for i in (2, 3)) < quality.BANDS["fr"][0]
    assert [i for i, r in sorted(judged.items()) if r.kept] == [1, 2, 3]


def test_short_clean_documents_of_the_table_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    some = docs.where(F.col("doc_id").isin(5854, 8007, 7754, 1110))
    assert {r.doc_id for r in quality.keep_good(some).collect()} == {5854, 8007, 7754, 1110}


def check_mix(found, sizes):
    shares = brute.mix_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in found:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(shares[r.source], rel=1e-12)
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s, target in shares.items():
        assert abs(taken[s] - target) <= 1, s


def test_mix(spark, edge):
    found = mixing.mix(edge).collect()
    assert len(found) == len(brute.EDGE)
    sizes: dict = {}
    for _, text, _, source in brute.EDGE:
        sizes[source] = sizes.get(source, 0) + len(brute.WORD.findall(text or ""))
    check_mix(found, sizes)
    again = mixing.mix(edge.repartition(5)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))
    assert mixing.mix(edge.limit(0)).count() == 0


def test_mix_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    sizes: dict = {}
    source = {}
    for r in docs:
        sizes[r.source] = sizes.get(r.source, 0) + len(brute.WORD.findall(r.text or ""))
        source[r.doc_id] = r.source
    found = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    check_mix(found, sizes)


def test_mixed_documents(spark, edge):
    plan = mixing.mix(edge).groupBy("source").agg(F.sum("taken").alias("n")).collect()
    docs = mixing.mixed_documents(edge)
    assert docs.columns == edge.columns
    got: dict = {}
    known = {t for _, t, _, _ in brute.EDGE if t}
    for r in docs.collect():
        got[r.source] = got.get(r.source, 0) + len(brute.WORD.findall(r.text))
        assert r.text in known or any(t.startswith(r.text) for t in known)
    assert got == {r.source: r.n for r in plan if r.n}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.just(0), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=300), min_size=1, max_size=4))
def test_simple8b_round_trip(documents):
    block = tokenfile._Block(0)
    for i, ids in enumerate(documents):
        words, odd, _, _ = tokenfile.pack(np.array([*ids, 0], np.uint64))
        block.add(i, len(ids) + 1, words.tobytes(), odd.tobytes())
    back = tokenfile.decode_block(block.close())
    assert [x.tolist() for x in back] == [[*ids, 0] for ids in documents]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**16 - 1) | st.just(0) | st.integers(0, 2**64 - 1), max_size=150), min_size=1, max_size=6))
def test_many_documents_pack_as_each_alone(documents):
    """Words end where documents end, also behind long runs of zeros and escapes."""
    documents = [[*ids, *[0] * 70, *ids[:3]] for ids in documents] + [[]]
    words, odd, n_words, n_odd = tokenfile.pack(np.array(sum(documents, []), np.uint64), np.array([len(x) for x in documents]))
    each = [tokenfile.pack(np.array(x, np.uint64))[:2] for x in documents]
    assert [x.tolist() for x in np.split(words, np.cumsum(n_words)[:-1])] == [w.tolist() for w, _ in each]
    assert [x.tolist() for x in np.split(odd, np.cumsum(n_odd)[:-1])] == [e.tolist() for _, e in each]


_SIGN = st.sampled_from(list("aZéÜİıŉſΣς09 .,'|<>-_\n\t\x1c\x7f\x85\u200b漢ß") + ["<|endoftext|>", "'s", " x", "e\u0301"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(_SIGN, max_size=40).map("".join), min_size=1, max_size=5))
def test_texts_together_are_the_tokenizer(texts):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        ids, n = encoder(name).encode_many([*texts, None])
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [brute.tokens(name)(t) for t in [*texts, ""]]


def test_chunks_are_the_tokenizer(spark):
    texts = [t or "" for _, t, _, _ in brute.EDGE] + ["a  b\n\n c\t\td 's 'll x  y", " lead", "trail  ", "é ́x İΣΣ"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encoder, plain = Encoder(name), brute.tokens(name)
        for text in texts + texts:
            assert encoder.encode(text).tolist() == plain(text), (name, text[:60])


def test_token_files(spark, edge):
    plain = brute.tokens("byte_bpe_50k.json")
    found = tokenfile.read_checks(tokenfile.write_token_files(edge, block_ids=64)).orderBy("start").collect()
    want = sorted(((d, crc := brute.crc([*plain(t), 0]), len(plain(t)) + 1) for d, t, _, _ in brute.EDGE), key=repr)
    assert sorted(((r.doc_id, r.ids_crc32, r.n_tokens) for r in found), key=repr) == want
    place = 0
    for r in found:
        assert r.start == place
        place += r.n_tokens
    ids = [r.doc_id for r in found]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    assert tokenfile.read_checks(tokenfile.write_token_files(edge.limit(0))).count() == 0


def test_token_query(spark):
    plain = brute.tokens("byte_bpe_50k.json")
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id)
    found = {r.doc_id: r for r in queries.op10_simple8b_files(spark, SF).collect()}
    place = 0
    for d in docs:
        ids = [*plain(d.text), 0]
        r = found[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (place, len(ids), brute.crc(ids))
        place += len(ids)


def test_texts_go_to_python_once_and_in_small_batches(spark):
    """Quality rules hand the text over beside the other columns, and written steps use batches of bounded size."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = quality.keep_good(docs)
    sent = [x for x in good._jdf.queryExecution().optimizedPlan().toString().splitlines() if "MapInArrow" in x]
    assert len(sent) == 1
    below = good._jdf.queryExecution().optimizedPlan().toString().split(sent[0])[1].splitlines()[1]
    assert "struct(" in below and "text, text#" not in below, below
    judged = quality.judge(quality.measure(docs), F.col("_row.lang")).where("kept").select("_row.*")
    assert good.columns == docs.columns and sorted(good.collect(), key=str) == sorted(judged.collect(), key=str)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    wide = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    seen = [r["n"] for r in common.pinned(wide.mapInArrow(sizes, "n long"), "sizes").collect()]
    assert sum(seen) > 40 << 20 and max(seen) <= common.BATCH_BYTES + (2 << 20)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_new_runs_are_learned_once():
    library = Encoder(tokenfile.VOCABULARY)
    asked = []
    merge = library.merge
    library.merge = lambda x: asked.append(x) or merge(x)
    texts = ["red fox", "", "red fox " + "x" * 90, None, "fox red red"]
    for _ in range(2):
        ids, counts = library.encode_many(texts)
        wanted = [library.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == sum(wanted, []) and counts.tolist() == [len(x) for x in wanted]
    assert len([x for x in asked if "x" * 90 not in x]) == len({x for x in asked if "x" * 90 not in x})
    assert not any("x" * 90 in x for x in library.known)


def test_pieces_are_kept_flat_and_long_words_are_not_kept():
    pieces = quality._Pieces(common.vocabulary(quality.PIECES), keep=4)
    words = [b"red", b"x" * 4000, "größe".encode(), b"a1"]
    for _ in range(3):
        flat, size = pieces.encode(words)
        wanted = [pieces.model.encode(w.decode()) for w in words]
        assert flat.tolist() == sum(wanted, []) and size.tolist() == [len(x) for x in wanted]
        assert sorted(pieces.known) == sorted(w for w in words if len(w) < 100)
    assert pieces.table.n == 3 and pieces.table.n_ids == len(flat) - size[1]
    assert pieces.encode([])[1].tolist() == []
