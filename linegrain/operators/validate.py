"""Checks on imported rows, and the merge of accepted rows into a stored corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linegrain.functions import text as tx
from linegrain.scale import list_pages
from linegrain.session import cut

REQUIRED = ["source_name", "artifact_id", "line_id", "sign_sequence", "provenance_url"]
HARD_RATE_LIMIT = 0.05
DUPLICATE_KEY = ["k_source", "k_artifact", "k_line", "sanitized"]
MERGE_KEY = ["artifact_id", "line_id", "sign_sequence"]
BUCKETS = 256
LISTS = ["source_id", "source_name", "provenance", "provenance_url", "notes"]


def _text(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit("")))


def prepare(rows: DataFrame) -> DataFrame:
    """Rows with their tokens, the first hard issue (or NULL) and the duplicate key.

    ``rows`` needs ``row_number`` and the columns of ``REQUIRED``, all strings.
    """

    def once(df: DataFrame, **columns: Column) -> DataFrame:
        # Behind a one-row generator an expression is worked out once, whatever uses it.
        return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))

    split = once(once(rows, seq=tx.canonical_sequence(F.col("sign_sequence"))), toks=tx.tokens(F.col("seq")))
    valid = once(split, valid=F.filter("toks", tx.shape_ok))
    odd = F.filter("toks", lambda t: ~tx.shape_ok(t))
    all_good = F.size("valid") == F.size("toks")
    shaped = once(valid, bad=F.when(all_good, F.array().cast("array<string>")).otherwise(odd)).withColumn(
        "sanitized", F.array_join("valid", " ")
    )
    good = F.size("valid")
    missing = F.filter(
        F.array(*[F.when(_text(c) == "", F.lit(c)) for c in REQUIRED]), lambda c: c.isNotNull()
    )

    def issue(name: str, details: Column) -> Column:
        return F.struct(F.lit(name).alias("issue"), details.alias("details"))

    after = "malformed_sequence_after_sanitation"
    hard = (
        F.when(F.size(missing) > 0, issue("missing_required_fields", F.array_join(missing, ",")))
        .when(~tx.plausible(F.col("toks"), good), issue("malformed_sequence", F.col("seq")))
        .when(good == 0, issue(after, F.col("seq")))
        .when(~all_good & ~tx.plausible(F.col("valid"), good), issue(after, F.col("sanitized")))
    )
    return shaped.withColumn("hard", hard).withColumns(
        {
            "k_source": _text("source_name"),
            "k_artifact": F.upper(_text("artifact_id")),
            "k_line": _text("line_id"),
        }
    )


def mark_repeats(prepared: DataFrame) -> DataFrame:
    """Accepted rows with ``is_repeat``: all but the first row of each duplicate key.

    The first row is a map-side combined minimum, so a key with very many
    copies never gathers in one task.
    """
    accepted = prepared.where(F.col("hard").isNull()).withColumn("_key", key_hash(*DUPLICATE_KEY))
    first = accepted.groupBy("_key").agg(F.min("row_number").alias("first_row"))
    return accepted.join(first, "_key", "left").drop("_key").withColumn(
        "is_repeat", F.col("row_number") > F.col("first_row")
    )


def inventory(*token_columns: DataFrame) -> DataFrame:
    """Distinct non-empty tokens of one-column DataFrames."""
    merged = None
    for df in token_columns:
        tokens = df.toDF("token").distinct()
        merged = tokens if merged is None else merged.unionByName(tokens)
    return merged.where(F.col("token") != "").distinct()


def unknown_tokens(prepared: DataFrame, known: DataFrame) -> DataFrame:
    """Tokens of accepted rows that the inventory lacks, one row per row and token."""
    accepted = prepared.where(F.col("hard").isNull())
    pairs = accepted.select("row_number", F.explode(F.array_distinct("valid")).alias("token"))
    hits = pairs.join(cut(known).withColumn("known", F.lit(True)), ["token"], "left")
    return hits.where(F.col("known").isNull()).drop("known")


def issues(prepared: DataFrame, repeats: DataFrame, unknown: DataFrame) -> DataFrame:
    """Every hard issue and warning, in one table."""
    row = ["row_number", "source_name", "artifact_id", "line_id", "sign_sequence"]

    def warn(df: DataFrame, name: str, details: Column) -> DataFrame:
        return df.select(
            *row, F.lit("warn").alias("severity"), F.lit(name).alias("issue"), details.alias("details")
        )

    hard = prepared.where(F.col("hard").isNotNull()).select(
        *row, F.lit("hard").alias("severity"), "hard.issue", "hard.details"
    )
    reached = F.col("hard").isNull() | (
        (F.col("hard.issue") == "malformed_sequence_after_sanitation") & (F.size("valid") > 0)
    )
    odd = F.array_join(F.array_sort(F.array_distinct("bad")), ",")
    inconsistent = warn(
        prepared.where(reached & (F.size("bad") > 0)),
        "inconsistent_sign_ids",
        odd,
    )
    shown = unknown.groupBy("row_number").agg(
        F.array_join(F.array_sort(F.collect_set("token")), ",").alias("shown")
    )
    strange = warn(
        prepared.join(shown, "row_number"), "unknown_sign_not_in_inventory", F.col("shown")
    )
    duplicate = warn(
        repeats.where("is_repeat"), "duplicate_line", F.lit("exact_duplicate_key")
    )
    return hard.unionByName(inconsistent).unionByName(strange).unionByName(duplicate)


def accepted_rows(repeats: DataFrame) -> DataFrame:
    return repeats.where(~F.col("is_repeat")).select(
        "row_number",
        F.col("k_source").alias("source_name"),
        tx.artifact_key(F.col("artifact_id")).alias("artifact_id"),
        F.col("k_line").alias("line_id"),
        F.col("sanitized").alias("sign_sequence"),
        _text("provenance_url").alias("provenance_url"),
        _text("notes").alias("notes"),
    )


def summary(prepared: DataFrame, issue_rows: DataFrame) -> DataFrame:
    """Totals and the gate: a merge is off when too many rows have a hard issue."""
    total = prepared.agg(F.count(F.lit(1)).alias("total_rows"))
    hard = F.col("severity") == "hard"
    found = issue_rows.agg(
        F.count_if(hard).alias("hard_issue_count"),
        F.count_if(~hard).alias("warning_count"),
        F.count_if(F.col("issue") == "duplicate_line").alias("_repeats"),
    )
    rate = F.when(F.col("total_rows") > 0, F.col("hard_issue_count") / F.col("total_rows"))
    counted = found.withColumn("total_rows", total.scalar())
    return counted.select(
        "total_rows",
        (F.col("total_rows") - F.col("hard_issue_count") - F.col("_repeats")).alias("valid_rows"),
        "hard_issue_count",
        "warning_count",
        F.coalesce(rate, F.lit(0.0)).alias("hard_issue_rate"),
        (F.coalesce(rate, F.lit(0.0)) > HARD_RATE_LIMIT).alias("merge_aborted"),
    )


def require_gate(summary_row: DataFrame) -> None:
    """Raise when the gate of a validation summary is closed."""
    row = summary_row.first()
    if row["merge_aborted"]:
        raise ValueError(
            f"hard validation issues in {row['hard_issue_rate']:.2%} of the rows; merge aborted"
        )


def validate(rows: DataFrame, known: DataFrame) -> dict[str, DataFrame]:
    prepared = cut(prepare(rows))
    repeats = mark_repeats(prepared)
    unknown = unknown_tokens(prepared, known)
    found = issues(prepared, repeats, unknown)
    return {
        "issues": found,
        "rows": accepted_rows(repeats),
        "unknown": unknown,
        "summary": summary(prepared, found),
    }


def normalize_stored(rows: DataFrame) -> DataFrame:
    """Stored rows in today's form; rows without a sequence or an artifact are left out."""

    def or_else(*choices: Column) -> Column:
        return F.coalesce(*[F.nullif(c, F.lit("")) for c in choices])

    name = or_else(_text("source_name"), _text("source_id"), F.lit("external"))
    url = _text("provenance_url")
    shaped = rows.select(
        "row_number",
        name.alias("source_name"),
        or_else(_text("source_id"), tx.slug(name)).alias("source_id"),
        tx.artifact_key(_text("artifact_id")).alias("artifact_id"),
        or_else(_text("line_id"), F.lit("line_unknown")).alias("line_id"),
        tx.canonical_sequence(_text("sign_sequence")).alias("sign_sequence"),
        or_else(_text("provenance"), url, F.lit("external_import")).alias("provenance"),
        _text("notes").alias("notes"),
        _text("ingestion_timestamp").alias("ingestion_timestamp"),
        url.alias("provenance_url"),
    )
    return shaped.where((F.col("sign_sequence") != "") & (F.col("artifact_id") != ""))


def _incoming(stored: DataFrame, new: DataFrame, now: str) -> DataFrame:
    fresh = new.select(
        "row_number",
        "source_name",
        tx.slug(F.col("source_name")).alias("source_id"),
        "artifact_id",
        "line_id",
        "sign_sequence",
        F.col("provenance_url").alias("provenance"),
        F.coalesce("notes", F.lit("")).alias("notes"),
        F.lit(now).alias("ingestion_timestamp"),
        "provenance_url",
    )
    old = stored.withColumn("is_new", F.lit(False))
    return old.unionByName(fresh.withColumn("is_new", F.lit(True)))


def _digest(*columns: Column | str) -> Column:
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.sha2(F.concat(*[F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts]), 256)


def key_hash(*columns: Column | str) -> Column:
    """128 bits of SHA-256 that stand for columns, a merge key if none are named.

    Sequences may be long, and a key goes through every shuffle.
    """
    return F.unhex(F.left(_digest(*(columns or MERGE_KEY)), F.lit(32)))


def merge_lists(stored: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """Sources, ids, provenance and notes of every merged key, in pages of bounded size."""
    both = _incoming(stored, new, now).withColumn("key", key_hash())
    pairs = [F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in LISTS]
    # A link is provenance as well.
    pairs.append(F.struct(F.lit("provenance").alias("field"), F.col("provenance_url").alias("value")))
    long = both.select("key", F.inline(F.array(*pairs))).where(F.col("value") != "")
    separator = F.when(F.col("field") == "source_id", "|").otherwise(" | ")
    pages = list_pages(long, ["key", "field"], "value", separator, near=["key"])
    # New rows move their texts only where no stored row has them.
    held, fresh = both.where("not is_new"), both.where("is_new")
    texts = held.unionByName(fresh.join(held.select("key"), "key", "left_anti"))
    texts = texts.groupBy("key").agg(*[F.any_value(c).alias(c) for c in MERGE_KEY])
    return pages.join(texts, "key").select(*MERGE_KEY, "field", "page", "items", "item_count")


def merge(stored: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """The full union by (artifact, line, sequence), with the whole lists of every key.

    One shuffle on the hash of the key does it all: sets combine map-side, so
    a key with very many copies costs one partial row a task. A cell is as long
    as its list.
    """
    order = F.struct("is_new", "row_number")
    sets = {c: F.collect_set(F.when(F.col(c) != "", F.col(c))) for c in LISTS}
    # A link is provenance as well.
    sets["provenance"] = F.array_union(sets["provenance"], sets["provenance_url"])
    rolled = _incoming(stored, new, now).withColumn("key", key_hash()).groupBy("key").agg(
        *[F.any_value(c).alias(c) for c in MERGE_KEY],
        *[F.array_join(F.array_sort(v), "|" if c == "source_id" else " | ").alias(c) for c, v in sets.items()],
        F.bool_or("is_new").alias("touched"),
        F.min_by("ingestion_timestamp", order).alias("first_stamp"),
        F.count(F.lit(1)).alias("merged_rows"),
    )
    stamp = F.when(F.col("touched"), F.lit(now)).otherwise(F.col("first_stamp")).alias("ingestion_timestamp")
    return rolled.select(*MERGE_KEY, *LISTS, stamp, "merged_rows")


def bucket_of(buckets: int = BUCKETS) -> Column:
    """Where a merge key is stored, from the first bytes of its hash."""
    head = F.conv(F.left(_digest(*MERGE_KEY), F.lit(8)), 16, 10).cast("long")
    return (head % buckets).cast("int")


def write_corpus(rows: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """A corpus as one folder a bucket; only the buckets that ``rows`` have are replaced."""
    kept = rows.withColumn("bucket", bucket_of(buckets))
    writer = kept.repartition("bucket", F.xxhash64(*MERGE_KEY) % 8).write.mode("overwrite").partitionBy("bucket")
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def upsert(spark: SparkSession, path: str, new: DataFrame, now: str, buckets: int = BUCKETS) -> DataFrame:
    """Merges rows into the corpus at ``path`` and returns the keys that came or changed.

    Buckets that get no row are neither read nor written. The merged rows are
    checkpointed before a bucket is replaced, so the job can be run again.
    """
    fresh = cut(new.withColumn("bucket", bucket_of(buckets)))
    # At most as many numbers as there are buckets.
    touched = [r[0] for r in fresh.select("bucket").distinct().collect()]
    if not touched:
        return spark.read.parquet(path).limit(0).drop("bucket")
    held = spark.read.parquet(path).where(F.col("bucket").isin(touched))
    # A stored cell holds a list; its values are merged one by one.
    merged = cut(merge(normalize_stored(unrolled(held)), fresh.drop("bucket"), now))
    write_corpus(merged, path, buckets)
    return merged.where(F.col("ingestion_timestamp") == now)


def unrolled(stored: DataFrame) -> DataFrame:
    """Stored rows with a row for each place of their lists, the values of one place side by side."""
    lists = {c: F.split(F.coalesce(c, F.lit("")), r"\|" if c == "source_id" else r" \| ") for c in LISTS}
    widest = F.greatest(*[F.size(v) for v in lists.values()])
    each = stored.withColumn("_at", F.explode(F.sequence(F.lit(0), widest - 1)))
    values = {c: F.coalesce(F.get(v, F.col("_at")), F.lit("")) for c, v in lists.items()}
    # A name or id that is not there must not be made up from a default: the first of the list stands in.
    for c in ("source_id", "source_name", "provenance"):
        values[c] = F.coalesce(F.nullif(values[c], F.lit("")), F.get(lists[c], F.lit(0)))
    return each.withColumns(values).withColumn("row_number", F.xxhash64(*MERGE_KEY, "_at")).drop("_at", "bucket")
