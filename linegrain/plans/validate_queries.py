"""Validation of document lines as imported rows, and merges into stored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from linegrain.checks import corpus_sql as q
from linegrain.functions import text as tx
from linegrain.operators import validate as va
from linegrain.plans.registry import query
from linegrain.session import cut, released, stored
from linegrain.sources import corpora

NOW = "2026-01-01T00:00:00Z"
BEFORE = "2025-01-01T00:00:00Z"

IMPORT = f"""{q.RAW_DOCS}, lk AS (SELECT d.doc_id, n_chars, quality FROM documents d
    LEFT JOIN (SELECT DISTINCT doc_id, quality FROM labels) USING (doc_id)),
  imp AS (SELECT doc_id * 1000000 + line_no AS row_number, source AS source_name,
      source AS artifact_id, lang AS line_id, line AS sign_sequence,
      CASE WHEN n_chars % 97 = 0 THEN '' ELSE 'doc://' || doc_id END AS provenance_url,
      'chars=' || n_chars AS notes, quality
    FROM raw_docs JOIN lk USING (doc_id))"""

PREPARED = f"""{IMPORT}, p0 AS (SELECT *, {q.canonical("sign_sequence")} AS seq FROM imp),
  p1 AS (SELECT *, {q.toks("seq")} AS toks FROM p0),
  p2 AS (SELECT *, list_filter(toks, lambda t: regexp_matches(t, '{q.SHAPE}')) AS valid,
      list_filter(toks, lambda t: NOT regexp_matches(t, '{q.SHAPE}')) AS bad FROM p1),
  p3 AS (SELECT *, array_to_string(valid, ' ') AS sanitized,
      array_to_string(list_filter([CASE WHEN trim(source_name) = '' THEN 'source_name' END,
        CASE WHEN trim(artifact_id) = '' THEN 'artifact_id' END,
        CASE WHEN trim(line_id) = '' THEN 'line_id' END,
        CASE WHEN trim(sign_sequence) = '' THEN 'sign_sequence' END,
        CASE WHEN trim(provenance_url) = '' THEN 'provenance_url' END],
        lambda c: c IS NOT NULL), ',') AS missing FROM p2),
  prep AS (SELECT *, CASE WHEN missing <> '' THEN 'missing_required_fields'
      WHEN NOT {q.plausible("toks")} THEN 'malformed_sequence'
      WHEN len(valid) = 0 THEN 'malformed_sequence_after_sanitation'
      WHEN NOT {q.plausible("valid")} THEN 'malformed_sequence_after_sanitation' END AS hard,
      CASE WHEN missing <> '' THEN missing WHEN NOT {q.plausible("toks")} THEN seq
      WHEN len(valid) = 0 THEN seq ELSE sanitized END AS hard_details FROM p3),
  ok_ AS (SELECT *, row_number() OVER (PARTITION BY trim(source_name), upper(trim(artifact_id)),
      trim(line_id), sanitized ORDER BY row_number) AS nth FROM prep WHERE hard IS NULL)"""

INVENTORY = f"""{q.VM_ROWS}, inv AS (
    SELECT DISTINCT token FROM (
      SELECT unnest({q.toks("text")}) AS token FROM benchmark
      UNION ALL SELECT unnest({q.toks("text")}) FROM conversations
      UNION ALL SELECT variant FROM vm UNION ALL SELECT canonical FROM vm) WHERE token <> '')"""

UNKNOWN = """unk AS (SELECT row_number, token FROM (
    SELECT row_number, unnest(list_distinct(valid)) AS token FROM ok_)
  WHERE token NOT IN (SELECT token FROM inv))"""

ISSUES = f"""WITH {PREPARED}, {INVENTORY}, {UNKNOWN},
  issues AS (
    SELECT row_number, source_name, artifact_id, line_id, sign_sequence, 'hard' AS severity,
      hard AS issue, hard_details AS details FROM prep WHERE hard IS NOT NULL
    UNION ALL SELECT row_number, source_name, artifact_id, line_id, sign_sequence, 'warn',
      'inconsistent_sign_ids',
      array_to_string(list_sort(list_distinct(bad)), ',') FROM prep
      WHERE len(bad) > 0 AND len(valid) > 0
        AND (hard IS NULL OR hard = 'malformed_sequence_after_sanitation')
    UNION ALL SELECT row_number, source_name, artifact_id, line_id, sign_sequence, 'warn',
      'unknown_sign_not_in_inventory', array_to_string(ts, ',') FROM prep JOIN (
        SELECT row_number, list_sort(list(token)) AS ts FROM unk GROUP BY row_number)
        USING (row_number)
    UNION ALL SELECT row_number, source_name, artifact_id, line_id, sign_sequence, 'warn',
      'duplicate_line', 'exact_duplicate_key' FROM ok_ WHERE nth > 1)"""


def import_rows(spark, sf):
    docs = corpora.table(spark, sf, "documents")
    lines = corpora.text_lines(docs, "doc_id", "text", "lang", "source", "n_chars")
    return lines.select(
        "doc_id",
        (F.col("doc_id") * 1_000_000 + F.col("line_no")).alias("row_number"),
        F.col("source").alias("source_name"),
        F.col("source").alias("artifact_id"),
        F.col("lang").alias("line_id"),
        F.col("line").alias("sign_sequence"),
        F.when(F.col("n_chars") % 97 == 0, "")
        .otherwise(F.concat(F.lit("doc://"), "doc_id"))
        .alias("provenance_url"),
        F.concat(F.lit("chars="), "n_chars").alias("notes"),
    )


def known_tokens(spark, sf):
    variants = corpora.variants(spark, sf)
    texts = [corpora.table(spark, sf, n).select("text") for n in ("benchmark", "conversations")]
    return va.inventory(
        *[t.select(F.explode(tx.tokens(F.col("text")))) for t in texts],
        variants.select("variant"),
        variants.select("canonical"),
    )


@query(
    "val_issues",
    f"{ISSUES} SELECT * FROM issues",
)
def val_issues(spark, sf):
    return va.validate(import_rows(spark, sf), known_tokens(spark, sf))["issues"]


@query("val_inventory", f"WITH {q.RAW_DOCS}, {INVENTORY} SELECT token FROM inv")
def val_inventory(spark, sf):
    return known_tokens(spark, sf)


@query(
    "val_unknown_tokens",
    f"WITH {PREPARED}, {INVENTORY}, {UNKNOWN} SELECT token, count(*) AS rows FROM unk GROUP BY token",
)
def val_unknown_tokens(spark, sf):
    prepared = cut(va.prepare(import_rows(spark, sf)))
    unknown = va.unknown_tokens(prepared, known_tokens(spark, sf))
    return unknown.groupBy("token").agg(F.count(F.lit(1)).alias("rows"))


_KEY = rf"""{q.collapse(f"regexp_replace({q.up('artifact_id')}, '[^A-Z0-9 ]+', ' ', 'g')")}"""


@query(
    "val_dedup_first",
    f"""WITH {PREPARED} SELECT row_number, source_name, {_KEY} AS artifact_id, line_id,
      sanitized AS sign_sequence, provenance_url, notes FROM ok_ WHERE nth = 1""",
)
def val_dedup_first(spark, sf):
    return va.accepted_rows(va.mark_repeats(cut(va.prepare(import_rows(spark, sf)))))


@query(
    "val_summary_gate",
    f"""{ISSUES}, n AS (SELECT count(*) AS total_rows FROM prep),
      c AS (SELECT count(*) FILTER (severity = 'hard') AS hard_issue_count,
        count(*) FILTER (severity = 'warn') AS warning_count FROM issues)
    SELECT total_rows, (SELECT count(*) FROM ok_ WHERE nth = 1) AS valid_rows, hard_issue_count,
      warning_count, hard_issue_count / total_rows AS hard_issue_rate,
      hard_issue_count / total_rows > 0.05 AS merge_aborted FROM n, c""",
)
def val_summary_gate(spark, sf):
    return va.validate(import_rows(spark, sf), known_tokens(spark, sf))["summary"]


STORED = f"""st AS (SELECT row_number, source_name,
      trim(regexp_replace(lower(source_name), '[^a-z0-9]+', '_', 'g'), '_') AS source_id,
      {_KEY} AS artifact_id, line_id, {q.canonical("sign_sequence")} AS sign_sequence,
      coalesce(nullif(provenance_url, ''), 'external_import') AS provenance, notes,
      '{BEFORE}' AS ingestion_timestamp, provenance_url FROM imp),
  stored AS (SELECT * FROM st WHERE sign_sequence <> '' AND artifact_id <> '')"""


def stored_rows(spark, sf):
    rows = import_rows(spark, sf).withColumns(
        {
            "source_id": F.lit(""),
            "provenance": F.lit(None).cast("string"),
            "ingestion_timestamp": F.lit(BEFORE),
        }
    )
    return va.normalize_stored(rows)


@query("merge_normalize_existing", f"WITH {IMPORT}, {STORED} SELECT * FROM stored")
def merge_normalize_existing(spark, sf):
    return stored_rows(spark, sf)


# Stored: all document lines. New: the accepted lines of all documents.
MERGE = f"""WITH {PREPARED}, {STORED},
  fresh AS (SELECT row_number, source_name,
      trim(regexp_replace(lower(source_name), '[^a-z0-9]+', '_', 'g'), '_') AS source_id,
      {_KEY} AS artifact_id, line_id, sanitized AS sign_sequence, provenance_url AS provenance,
      notes, '{NOW}' AS ingestion_timestamp, provenance_url FROM ok_ WHERE nth = 1),
  both_ AS (SELECT *, false AS is_new FROM stored UNION ALL BY NAME SELECT *, true AS is_new
    FROM fresh),
  long AS (SELECT DISTINCT artifact_id, line_id, sign_sequence, field, value FROM (
      SELECT artifact_id, line_id, sign_sequence, unnest(['source_id', 'source_name',
        'provenance', 'provenance_url', 'notes', 'provenance']) AS field, unnest([source_id,
        source_name, provenance, provenance_url, notes, provenance_url]) AS value FROM both_)
    WHERE value <> ''),
  paged AS (SELECT *, ((row_number() OVER (PARTITION BY artifact_id, line_id, sign_sequence, field
      ORDER BY value) - 1) // 1000)::INT AS page FROM long),
  lists AS (SELECT artifact_id, line_id, sign_sequence, field, page,
      CASE field WHEN 'source_id' THEN string_agg(value, '|' ORDER BY value)
      ELSE string_agg(value, ' | ' ORDER BY value) END AS items,
      count(*) AS item_count FROM paged
    GROUP BY artifact_id, line_id, sign_sequence, field, page),
  wholes AS (SELECT artifact_id, line_id, sign_sequence, field,
      CASE field WHEN 'source_id' THEN string_agg(value, '|' ORDER BY value)
      ELSE string_agg(value, ' | ' ORDER BY value) END AS items FROM long
    GROUP BY artifact_id, line_id, sign_sequence, field)"""


def merge_inputs(spark, sf):
    # What rows are made of stays behind; only what a merge reads is kept.
    prepared = stored(va.prepare(import_rows(spark, sf)).drop("seq", "toks", "valid", "bad", "sign_sequence", "doc_id"))
    fresh = stored(va.accepted_rows(va.mark_repeats(prepared)))
    released(prepared)
    return stored(stored_rows(spark, sf)), fresh


@query(
    "merge_upsert",
    f"""{MERGE} SELECT b.artifact_id, b.line_id, b.sign_sequence, source_id, source_name,
      provenance, coalesce(provenance_url, '') AS provenance_url, coalesce(notes, '') AS notes,
      CASE WHEN touched THEN '{NOW}' ELSE first_stamp END AS ingestion_timestamp, merged_rows
    FROM (SELECT artifact_id, line_id, sign_sequence, bool_or(is_new) AS touched,
        first(ingestion_timestamp ORDER BY is_new, row_number) AS first_stamp,
        count(*) AS merged_rows FROM both_ GROUP BY ALL) b
    JOIN (PIVOT (SELECT artifact_id, line_id, sign_sequence, field, items FROM wholes) ON field IN ('source_id', 'source_name', 'provenance', 'provenance_url',
        'notes') USING first(items)) l USING (artifact_id, line_id, sign_sequence)""",
)
def merge_upsert(spark, sf):
    held, fresh = merge_inputs(spark, sf)
    return va.merge(held, fresh, NOW)


@query("merge_upsert_lists", f"{MERGE} SELECT * FROM lists")
def merge_upsert_lists(spark, sf):
    held, fresh = merge_inputs(spark, sf)
    return va.merge_lists(held, fresh, NOW)
