"""Frequencies of tokens, n-grams, positions, prefixes and suffixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linegrain.functions import text as tx
from linegrain.scale import list_pages

DIGITS = 6


def shares(counts: DataFrame, count: str = "count") -> DataFrame:
    """Add each row's share of the total; the total is one row, read as a scalar subquery."""
    total = counts.agg(F.sum(count).alias("total")).scalar()
    return counts.withColumn("relative_frequency", F.round(F.col(count) / total, DIGITS))


def _counted(items: DataFrame, name: str) -> DataFrame:
    return shares(items.groupBy(name).agg(F.count(F.lit(1)).alias("count")))


def ngram_frequency(lines: DataFrame, n: int, name: str) -> DataFrame:
    """Share of every n-gram among all n-grams of that size."""
    grams = F.col("signs") if n == 1 else tx.ngrams(F.col("signs"), n)
    return _counted(lines.select(F.explode(grams).alias(name)), name)


def edge_frequency(lines: DataFrame, terminal: bool = False) -> DataFrame:
    """Share of lines that begin (or end) with each token."""
    edge = F.element_at("signs", -1 if terminal else 1)
    return _counted(lines.select(edge.alias("sign")), "sign")


def _edges(lines: DataFrame, suffix: bool, name: str) -> DataFrame:
    """One row per line and prefix (suffix) of one to three tokens."""
    n = F.explode(F.sequence(F.lit(1), F.least(F.lit(3), F.size("signs"))))
    each = lines.select("artifact_id", "signs", n.alias("length"))
    start: Column = F.size("signs") - F.col("length") + 1 if suffix else F.lit(1)
    text = F.array_join(F.slice("signs", start, F.col("length")), " ")
    return each.select("artifact_id", text.alias(name), "length")


def edge_patterns(lines: DataFrame, suffix: bool = False, least: int = 2) -> DataFrame:
    """Prefixes (suffixes) found at least twice, with the number of artifacts that have them.

    Counted in two steps, per artifact and then over artifacts, so that a very
    common pattern is combined map-side. The artifacts themselves are in
    :func:`edge_pattern_artifacts`.
    """
    name = "suffix" if suffix else "prefix"
    per = _edges(lines, suffix, name).groupBy(name, "length", "artifact_id")
    per = per.agg(F.count(F.lit(1)).alias("n"))
    rolled = per.groupBy(name, "length").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("artifact_count")
    )
    return rolled.where(F.col("count") >= least)


def edge_pattern_artifacts(lines: DataFrame, suffix: bool = False, least: int = 2) -> DataFrame:
    """The sorted artifacts of each pattern, in pages of bounded size."""
    name = "suffix" if suffix else "prefix"
    kept = edge_patterns(lines, suffix, least).select(name, "length")
    pairs = _edges(lines, suffix, name).distinct().join(kept, [name, "length"], "left_semi")
    return list_pages(pairs, [name, "length"], "artifact_id")
