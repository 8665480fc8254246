"""Corpora derived from landed Parquet tables.

``lines`` is the shape that all operators share:
``line_id, artifact_id, site, region STRING, signs ARRAY<STRING>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linegrain.functions import text as tx
from linegrain.sources.files import variant_map


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A landed table. A file too small to be split is dealt out over the cores.

    Tables with at least as many scan partitions as cores are left as they
    are, so nothing is shuffled at scale.
    """
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def session_lines(events: DataFrame) -> DataFrame:
    """Event types of each user and day, in time order, one line each."""
    base = events.select(
        "user_id",
        F.to_date("ts").alias("day"),
        "ts",
        "event_id",
        F.upper("event_type").alias("sign"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "sign")))
    built = base.groupBy("user_id", "day").agg(
        F.transform(ordered, lambda e: e["sign"]).alias("signs")
    )
    return built.select(
        F.concat_ws(
            "|",
            F.concat(F.lit("U"), F.col("user_id")),
            F.date_format("day", "yyyy-MM-dd"),
        ).alias("line_id"),
        F.concat(F.lit("U"), F.col("user_id")).alias("artifact_id"),
        F.concat(F.lit("S"), F.col("user_id") % 10).alias("site"),
        F.concat(F.lit("R"), F.col("user_id") % 3).alias("region"),
        "signs",
    )


def event_lines(spark: SparkSession, folder: str) -> DataFrame:
    return session_lines(table(spark, folder, "events"))


def text_lines(docs: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """One row per non-empty line of each text, numbered from 1."""
    return (
        docs.select(id_col, *keep, F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
        .select(id_col, *keep, (F.col("pos") + 1).alias("line_no"), F.trim("line").alias("line"))
        .where(F.col("line") != "")
    )


def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    raw = text_lines(table(spark, folder, "documents"), "doc_id", "text", "lang", "source")
    return raw.select(
        F.concat(F.lit("D"), "doc_id", F.lit("|"), "line_no").alias("line_id"),
        F.concat(F.lit("D"), "doc_id").alias("artifact_id"),
        F.upper("source").alias("site"),
        F.upper("lang").alias("region"),
        tx.tokens(F.col("line")).alias("signs"),
    ).where(F.size("signs") > 0)


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of documents (own material) and of conversations (imported material)."""
    docs = text_lines(table(spark, folder, "documents"), "doc_id", "text", "lang", "source")
    own = docs.select(
        F.concat(F.lit("D"), F.lpad("doc_id", 12, "0"), F.lit(":"), F.lpad("line_no", 9, "0"))
        .alias("observation_id"),
        F.concat(F.lit("doc:"), "doc_id").alias("source_id"),
        F.lit("doc_text").alias("source_kind"),
        F.upper("source").alias("artifact_id"),
        F.col("line_no").cast("string").alias("line_id"),
        "line_no",
        "line",
        F.concat(F.lit("doc:"), "doc_id").alias("provenance"),
        F.concat(F.lit("lang="), "lang").alias("notes"),
    )
    talk = text_lines(table(spark, folder, "conversations"), "conv_id", "text", "turn", "role")
    imported = talk.select(
        F.concat(
            F.lit("E"), F.lpad("conv_id", 12, "0"), F.lit(":"), F.lpad("turn", 9, "0"),
            F.lit(":"), F.lpad("line_no", 9, "0"),
        ).alias("observation_id"),
        F.concat(F.lit("external:conv"), "conv_id").alias("source_id"),
        F.lit("external_csv").alias("source_kind"),
        F.concat(F.lit("SRC"), F.col("conv_id") % 20).alias("artifact_id"),
        F.concat("turn", F.lit("."), "line_no").alias("line_id"),
        "line_no",
        "line",
        F.concat(F.lit("conv:"), "conv_id").alias("provenance"),
        F.concat(F.lit("role="), "role").alias("notes"),
    )

    def shaped(df: DataFrame) -> DataFrame:
        # Behind a one-row generator white space is collapsed once, whatever filters and columns use it.
        return df.select("*", F.inline(F.array(F.struct(tx.collapse(F.col("line")).alias("s")))))

    return shaped(own).unionByName(shaped(imported)).select(
        "observation_id",
        "source_id",
        "source_kind",
        "artifact_id",
        "line_id",
        "line_no",
        F.upper(tx.collapsed_surface(F.col("s"))).alias("sign_sequence"),
        tx.collapsed_quantity(F.col("s")).alias("quantity"),
        "provenance",
        "notes",
    )


def variant_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Variant map rows, as strings, for tokens of ``documents`` that end in punctuation."""
    docs = text_lines(table(spark, folder, "documents"), "doc_id", "text")
    t, stem, last = F.col("t"), F.regexp_extract("t", r"^(\p{L}+)", 1), F.right("t", F.lit(1))
    distinct = docs.select(F.explode(tx.tokens(F.col("line"))).alias("t")).distinct()

    def row(variant: Column, canonical: Column, status: str, confidence: str, notes: str) -> Column:
        return F.struct(
            variant.alias("variant"),
            canonical.alias("canonical"),
            F.lit(status).alias("status"),
            F.lit(confidence).alias("confidence"),
            F.lit(notes).alias("notes"),
        )

    rows = (
        F.when(last == ",", F.array(row(t, stem, "exact", "1.0", "comma")))
        .when(last == ".", F.array(row(t, stem, "high", "0.92", "stop")))
        .when(last == "#", F.array(row(t, stem, "uncertain", "0.35", "hash")))
        .when(last == "%", F.array(row(t, stem, "", "n/a", "")))
        .when(last == "$", F.array(row(t, F.lit(""), "canonical", "0.7", "dollar")))
        .when(
            last == "*",
            F.array(
                row(t, stem, "exact", "0.9", "star"),
                row(t, F.concat(stem, F.lit("*")), "exact", "0.6", "starred"),
            ),
        )
        .when(last == "&", F.array(row(F.concat(F.lit(" "), t), stem, "Strict", "1.7", "amp")))
    )
    punctuated = distinct.where(t.rlike(r"^\p{L}+[^\p{L}\p{N}]+$"))
    return punctuated.select(F.explode(rows).alias("r")).select("r.*")


def variants(spark: SparkSession, folder: str) -> DataFrame:
    return variant_map(variant_rows(spark, folder))


# Site codes that event users are spread over, and the tokens of event types.
SITE_CODES = [
    "HT", "KN", "ARKH", "PH", "PK", "ZA", "PE", "PS", "SY", "KH", "KE", "MI", "MA", "TH", "KY",
    "MY", "PYR", "TY", "QQ",
]
OBJECT_CODES = [" ", " WC ", " WA ", " Z "]
EVENT_TOKENS = {
    "PURCHASE": "GRA", "SIGNUP": "KU", "ERROR": "RO", "CLICK": "AB22", "VIEW": "A12",
}


def coded_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Event lines under catalogue codes, so that codes and tokens carry attributes.

    The user number picks the site and the kind of object; the day of the month
    is the quantity on every second day.
    """
    lines = event_lines(spark, folder)
    user = F.substring("artifact_id", 2, 20).cast("long")
    day = F.substring(F.split("line_id", r"\|")[1], 9, 2).cast("long")
    sites = F.array(*map(F.lit, SITE_CODES))
    objects = F.array(*map(F.lit, OBJECT_CODES))
    tokens = F.create_map(*[F.lit(x) for pair in EVENT_TOKENS.items() for x in pair])
    return lines.select(
        "line_id",
        F.concat(
            F.get(sites, user % len(SITE_CODES)), F.get(objects, user % len(OBJECT_CODES)), user
        ).alias("artifact_id"),
        F.transform("signs", lambda t: tokens[t]).alias("signs"),
        F.when(day % 2 == 0, day).alias("quantity"),
        F.concat(F.lit("user:"), user).alias("provenance"),
        F.when(user % 4 == 0, "html").otherwise("external_csv").alias("source_kind"),
    )
