"""Leaves, subroots, proofs and folded roots against a plain tree."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from linegrain.llm import manifest, queries
from tests.llm import brute

KIND = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v) -> str:
    if v is None:
        return "-"
    return f"{len(str(v).encode())}:{v}"


def levels(digests: list[str]) -> list[list[str]]:
    found = [digests]
    while len(found[-1]) > 1:
        last = found[-1]
        found.append([sha(*last[i : i + 8]) for i in range(0, len(last), 8)])
    return found


def path(tree: list[list[str]], at: int):
    """(siblings before, siblings after) level by level."""
    for level in tree[:-1]:
        run = level[at // 8 * 8 : at // 8 * 8 + 8]
        yield run[: at % 8], run[at % 8 + 1 :]
        at //= 8


def plain(rows: list[tuple]) -> list[tuple]:
    made: dict = {}
    for doc_id, source, lang, n, text in rows:
        leaf = sha(*map(framed, (doc_id, source, lang, n, text)))
        shown = leaf
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and text is not None:
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            shown = sha(*map(framed, (doc_id, source, lang, n, low)))
        made.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf, shown, doc_id))
    langs = sorted(made, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        made[lang].sort(key=lambda x: x[:4])
        trees[lang] = levels([x[2] for x in made[lang]])
    crown = levels([trees[x][-1][0] for x in langs])
    out = []
    for k, lang in enumerate(langs):
        for i, (_, _, leaf, shown, doc_id) in enumerate(made[lang]):
            steps = [*path(trees[lang], i), *path(crown, k)]
            folded, proof = shown, ""
            for before, after in steps:
                folded = sha(*before, folded, *after)
                proof += "".join(before + after)
            out.append((doc_id, leaf, trees[lang][-1][0], crown[-1][0], sha(proof), folded, folded == crown[-1][0]))
    return out


NAMES = [x.split()[0] for x in manifest.RESULT.split(", ")]


def check(spark, rows):
    df = spark.createDataFrame(rows, KIND).withColumn("leaf", F.lit("clash")).withColumn("tree", F.lit(1)).repartition(3)
    got = [tuple(r[n] for n in NAMES) for r in manifest.verify(df).select(*NAMES).collect()]
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)
    return got


def test_edge_rows(spark):
    """NULLs in every column, equal ids and rows, a long text, groups of 1, 8, 9, 65 and 600 rows."""
    rows = [(i, s, g, None if t is None else len(t), t) for i, t, g, s in brute.EDGE]
    rows += [(None, None, None, None, None), (3, None, None, 0, ""), (3, None, None, 0, "")]
    for lang, n in [("one", 1), ("eight", 8), ("nine", 9), ("z65", 65), ("hot", 600)]:
        rows += [(i * 7 % 1000, "s", lang, i, f"Text NUMBER {i} É") for i in range(n)]
    got = check(spark, rows)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 9])
def test_few_rows_of_one_group(spark, n):
    check(spark, [(i, "s", None, 1, "A b") for i in range(n)])


def test_many_groups(spark):
    check(spark, [(i, "s", f"g{i}", 1, "A b") for i in range(20)])


def test_no_rows(spark):
    empty = manifest.verify(spark.createDataFrame([], KIND))
    assert empty.count() == 0 and empty.columns == NAMES


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select(*manifest.FIELDS).collect()]
    got = [tuple(r[n] for n in NAMES) for r in queries.op12_merkle_climb(spark, folder).collect()]
    assert sorted(got) == sorted(plain(rows))
