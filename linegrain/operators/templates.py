"""Sequence types and positional templates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linegrain.scale import list_pages, ordered_index

SHARE = 0.60


def sequence_types(lines: DataFrame) -> DataFrame:
    """Distinct sequences with ``SEQ_001`` … by frequency, length and tokens.

    ``seq_no`` is the same number as an integer; it keeps its order past 999.
    """
    per = lines.groupBy("signs", "artifact_id").agg(F.count(F.lit(1)).alias("n"))
    types = per.groupBy("signs").agg(
        F.sum("n").alias("line_frequency"), F.count(F.lit(1)).alias("artifact_count")
    )
    keyed = types.withColumn("_f", -F.col("line_frequency")).withColumn("sequence_length", F.size("signs"))
    numbered = ordered_index(keyed, ["_f", "sequence_length", "signs"], "seq_no").drop("_f")
    return numbered.withColumn("sequence_id", F.format_string("SEQ_%03d", "seq_no"))


def sequence_type_artifacts(lines: DataFrame) -> DataFrame:
    """The sorted artifacts of each distinct sequence, in pages of bounded size."""
    pairs = lines.select(F.array_join("signs", " ").alias("sequence"), "artifact_id")
    return list_pages(pairs, ["sequence"], "artifact_id")


def position_counts(lines: DataFrame) -> DataFrame:
    """Lines by (length, position, token)."""
    each = lines.select(
        F.size("signs").alias("length"), F.posexplode("signs").alias("position", "token")
    )
    return each.groupBy("length", "position", "token").agg(F.count(F.lit(1)).alias("n"))


def templates(lines: DataFrame, share: float = SHARE) -> DataFrame:
    """Per length, the majority token at each position where it is dominant, else ``*``."""
    sizes = lines.groupBy(F.size("signs").alias("length")).agg(F.count(F.lit(1)).alias("lines"))
    sizes = sizes.where(F.col("lines") >= 2)
    top = position_counts(lines).groupBy("length", "position").agg(
        F.min_by("token", F.struct(-F.col("n"), "token")).alias("token"), F.max("n").alias("n")
    )
    kept = (F.col("n") / F.col("lines") >= share) & (F.col("n") >= 2)
    slots = top.join(sizes, "length").withColumn("slot", F.when(kept, F.col("token")).otherwise("*"))
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("position", "slot"))), lambda s: s["slot"]
    )
    # One slot per position of a length: the list is as long as one line.
    rows = slots.groupBy("length", "lines").agg(ordered.alias("slots"))
    rows = rows.where(F.exists("slots", lambda s: s != "*"))
    fits = F.forall(F.arrays_zip("signs", "slots"), lambda p: (p["slots"] == "*") | (p["signs"] == p["slots"]))
    tested = lines.select("signs", F.size("signs").alias("length")).join(rows, "length")
    covered = tested.groupBy("length").agg(F.count_if(fits).alias("matching"))
    return rows.join(covered, "length").select(
        F.col("length").alias("sequence_length"),
        F.array_join("slots", " ").alias("template"),
        F.size(F.filter("slots", lambda s: s != "*")).alias("fixed_positions"),
        F.col("lines").alias("entries_in_length_group"),
        F.round(F.col("matching") / F.col("lines"), 6).alias("coverage"),
    )


def weighted_coverage(lines: DataFrame, template_rows: DataFrame) -> DataFrame:
    """Mean coverage over the lines of templated lengths, and over all lines."""
    total = lines.agg(F.count(F.lit(1)).alias("n")).scalar()
    covered = F.coalesce(F.sum(F.col("coverage") * F.col("entries_in_length_group")), F.lit(0.0))
    rolled = template_rows.agg(
        covered.alias("covered"), F.sum("entries_in_length_group").alias("grouped")
    ).withColumn("all_lines", total)
    return rolled.select(
        F.round(F.coalesce(F.col("covered") / F.col("grouped"), F.lit(0.0)), 6).alias(
            "coverage_of_template_lines"
        ),
        F.round(F.col("covered") / F.greatest(F.lit(1), "all_lines"), 6).alias(
            "coverage_of_all_lines"
        ),
    )
