"""The routes for hot groups give what the plain routes give."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from linegrain import scale
from linegrain.sources import corpora


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 3 == 0 else f"k{rng.randrange(20)}", i, rng.randrange(50)) for i in range(600)]
    return spark.createDataFrame(rows, "k string, i int, v int").repartition(5).cache()


def test_ordered_index_counts_in_order(skewed):
    got = scale.ordered_index(skewed, ["v", "i"], "n").orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(1, 601))
    assert [(r["v"], r["i"]) for r in got] == sorted((r["v"], r["i"]) for r in got)


def test_ordered_cumsum(skewed):
    got = scale.ordered_cumsum(skewed, ["i"], "v").orderBy("i").collect()
    total = 0
    for r in got:
        assert r["before"] == total
        total += r["v"]


@pytest.mark.parametrize("limit", [10, 100, 10_000])
def test_group_rank_is_the_same_for_any_limit(skewed, limit):
    got = scale.group_rank(skewed, ["k"], ["v", "i"], limit=limit).collect()
    groups: dict[str, list] = {}
    for r in got:
        groups.setdefault(r["k"], []).append((r["rank"], r["v"], r["i"]))
    for rows in groups.values():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
        assert [r[1:] for r in rows] == sorted(r[1:] for r in rows)
    assert len(got) == 600


def test_carry_forward_is_an_as_of_join(spark):
    starts = [(i * i, f"s{i}") for i in range(1, 40)]
    rows = [(at, 0, owner) for at, owner in starts] + [(at, 1 + i, None) for i, at in enumerate(range(0, 1600, 7))]
    df = spark.createDataFrame(rows, "at long, i int, owner string").repartition(7)
    got = scale.carry_forward(df, ["at", "i"], "owner", "last").where("i > 0").collect()
    want = {i: max(((a, o) for a, o in starts if a <= at), default=(0, None))[1] for at, i, _ in rows if i}
    assert {r["i"]: r["last"] for r in got} == want


def test_list_pages_are_whole(skewed):
    pages = scale.list_pages(skewed.withColumn("s", F.lpad("v", 3, "0")), ["k"], "s", page=7)
    got: dict[str, list] = {}
    for r in sorted(pages.collect(), key=lambda r: (r["k"], r["page"])):
        got.setdefault(r["k"], []).extend(r["items"].split(","))
        assert r["item_count"] <= 7
    want: dict[str, set] = {}
    for r in skewed.collect():
        want.setdefault(r["k"], set()).add(f"{r['v']:03d}")
    assert got == {k: sorted(v) for k, v in want.items()}


def test_long_sessions_stay_one_line(spark):
    events = spark.range(2_500).select(
        F.lit(1).cast("long").alias("user_id"),
        F.col("id").alias("event_id"),
        F.timestamp_seconds(F.col("id")).alias("ts"),
        F.concat(F.lit("e"), F.col("id")).alias("event_type"),
    )
    (line,) = corpora.session_lines(events).collect()
    assert line["signs"] == [f"E{i}" for i in range(2_500)]


def test_list_pages_run_their_input_once(spark):
    """Sizing and ranking the groups does not work the input out again."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = spark.range(20).selectExpr("id % 3 AS k", "cast(id AS string) AS s").mapInPandas(count, "k bigint, s string")
    separator = F.when(F.col("k") == 1, "|").otherwise(" | ")
    pages = {r["k"]: r["items"] for r in scale.list_pages(rows, ["k"], "s", separator).collect()}
    assert pages == {k: ("|" if k == 1 else " | ").join(sorted(str(i) for i in range(20) if i % 3 == k)) for k in range(3)}
    assert seen.value == 20
