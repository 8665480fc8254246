"""Readers and writers over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from linegrain.checks import corpus_sql as q
from linegrain.functions import text as tx
from linegrain.plans.registry import query
from linegrain.session import checkpoint_dir
from linegrain.sources import corpora, files, pages, sinks


def _pages(spark, sf):
    return corpora.table(spark, sf, "pages")


@query(
    "src_variant_map",
    f"WITH {q.RAW_DOCS}, {q.VM_ROWS} SELECT variant, canonical, status, confidence, notes FROM vm",
)
def src_variant_map(spark, sf):
    return corpora.variants(spark, sf)


PAGE_BLOCK = r"(?is)<h1>[^<]*</h1>\s*<p>(.*?)</p>"


@query(
    "src_titled_block_lines",
    rf"""WITH b AS (SELECT page_id, regexp_split_to_array(regexp_extract(html, '{PAGE_BLOCK}', 1),
        '<br>|\. ') AS ls FROM pages),
      l AS (SELECT page_id, generate_subscripts(ls, 1) AS line_no, unnest(ls) AS line FROM b),
      s AS (SELECT page_id, line_no::INT AS line_no, {q.up(q.surface(q.collapse("line")))}
              AS sign_sequence, {q.quantity(q.collapse("line"))} AS quantity FROM l)
    SELECT * FROM s WHERE len({q.toks("sign_sequence")}) > 0""",
)
def src_titled_block_lines(spark, sf):
    return files.titled_block_lines(_pages(spark, sf), "page_id", "html", PAGE_BLOCK, r"<br>|\. ")


PAGE_NOTE = r"(?:<li><a[^>]*>|<p>)([^<.]+)"
PAGE_TITLE = r"^<h1>([^<]+)</h1>"


@query(
    "src_inline_annotations",
    rf"""WITH x AS (SELECT page_id, regexp_split_to_array(regexp_replace(html, '(<h1|<li|<p>)',
          chr(10) || '\1', 'g'), chr(10)) AS ls FROM pages),
      l AS (SELECT page_id, generate_subscripts(ls, 1) AS line_no, unnest(ls) AS line FROM x),
      t AS (SELECT *, CASE WHEN regexp_extract(trim(line), '{PAGE_TITLE}', 1) <> ''
              THEN {q.up(f"regexp_extract(trim(line), '{PAGE_TITLE}', 1)")} END AS title FROM l),
      o AS (SELECT *, coalesce(last_value(title IGNORE NULLS) OVER (PARTITION BY page_id
              ORDER BY line_no ROWS UNBOUNDED PRECEDING), 'PAGE' || page_id) AS artifact_id FROM t),
      m AS (SELECT page_id, artifact_id, line_no, regexp_extract_all(line, '{PAGE_NOTE}', 1) AS ns
            FROM o),
      n AS (SELECT page_id, artifact_id, line_no::INT AS line_no,
              (generate_subscripts(ns, 1) - 1)::INT AS note_no, unnest(ns) AS note FROM m),
      s AS (SELECT page_id, artifact_id, line_no, note_no, {q.up(q.surface("note"))}
              AS sign_sequence, {q.quantity("note")} AS quantity FROM n)
    SELECT * FROM s WHERE len({q.toks("sign_sequence")}) > 0""",
)
def src_inline_annotations(spark, sf):
    broken = _pages(spark, sf).select(
        "page_id", F.regexp_replace("html", "(<h1|<li|<p>)", "\n$1").alias("text")
    )
    return files.inline_annotations(
        broken,
        "page_id",
        "text",
        F.concat(F.lit("PAGE"), "page_id"),
        note=PAGE_NOTE,
        heading=PAGE_TITLE,
        artifact=".",
    )


_EXTERNAL_SQL = f"""ext AS (
  SELECT turn, 'external:' || role AS source_id, 'external_csv' AS source_kind,
    upper('conv' || conv_id) AS artifact_id, 't' || turn AS line_id, turn::INT AS line_no,
    {q.surface("text")} AS s, {q.quantity("text")} AS quantity,
    'conv://' || conv_id AS provenance,
    'turn ' || turn || ' | source=' || role || ' | ingested=2026-01-01T00:00:00Z' AS notes
  FROM conversations WHERE trim(text) <> '')"""


@query(
    "src_external_rows",
    f"""WITH {_EXTERNAL_SQL}
    SELECT source_id, source_kind, artifact_id, line_id, line_no, {q.up("s")} AS sign_sequence,
      quantity, provenance, notes FROM ext WHERE len({q.toks("s")}) > 0""",
)
def src_external_rows(spark, sf):
    talk = corpora.table(spark, sf, "conversations")
    rows = talk.select(
        F.lit("").alias("source_id"),
        F.concat(F.lit("conv"), "conv_id").alias("artifact_id"),
        F.concat(F.lit("t"), "turn").alias("line_id"),
        F.col("text").alias("sign_sequence"),
        F.lit(None).cast("string").alias("provenance"),
        F.concat(F.lit("turn "), "turn").alias("notes"),
        F.lit("2026-01-01T00:00:00Z").alias("ingestion_timestamp"),
        F.col("role").alias("source_name"),
        F.concat(F.lit("conv://"), "conv_id").alias("provenance_url"),
        "turn",
    )
    return files.external_observations(rows, "turn")


OBS_ORDER = ["source_kind", "observation_id"]


@query(
    "src_collect_observations",
    f"""WITH {q.OBS} SELECT printf('OBS_%06d', row_number() OVER (
        ORDER BY source_kind, observation_id)) AS observation_id, observation_id AS source_row,
      source_kind, artifact_id, line_id, sign_sequence, quantity
    FROM obs WHERE len({q.toks("sign_sequence")}) > 0""",
)
def src_collect_observations(spark, sf):
    obs = corpora.observations(spark, sf).where(F.size(tx.tokens(F.col("sign_sequence"))) > 0)
    renamed = obs.select(
        F.col("observation_id").alias("source_row"),
        "source_kind",
        "artifact_id",
        "line_id",
        "sign_sequence",
        "quantity",
    )
    return files.number_observations(renamed, ["source_kind", "source_row"])


SENTENCE = r"([^.]+)\."


@query(
    "src_html_table_rows",
    rf"""WITH h AS (SELECT page_id, regexp_extract_all(html, '<!-- (.*?) -->', 1) AS titles,
          regexp_split_to_array(html, '<!-- (.*?) -->')[2:] AS bodies FROM pages),
      s AS (SELECT page_id, generate_subscripts(titles, 1) - 1 AS s, unnest(titles) AS title,
          unnest(bodies) AS body FROM h),
      a AS (SELECT page_id, s,
          {q.collapse(f"regexp_replace({q.up(q.clean('title'))}, '[^A-Z0-9 ]+', ' ', 'g')")}
          AS artifact_id,
          regexp_extract_all(body, '(?is)<article[^>]*>(.*?)</article>', 1) AS ts FROM s),
      t AS (SELECT page_id, s, artifact_id, generate_subscripts(ts, 1) AS t, unnest(ts) AS inner_
          FROM a WHERE regexp_matches(artifact_id, '[0-9]')),
      rr AS (SELECT *, regexp_extract_all(inner_, '(?is)<p[^>]*>(.*?)</p>', 1) AS rs FROM t),
      r AS (SELECT page_id, s, artifact_id, t, generate_subscripts(rs, 1) AS r, unnest(rs) AS tr
          FROM rr),
      c AS (SELECT *, regexp_extract_all(tr, '{SENTENCE}', 1) AS cells FROM r),
      l AS (SELECT *, {q.clean("cells[1]")} AS label FROM c WHERE len(cells) >= 2),
      b AS (SELECT * FROM l WHERE NOT (r = 1 AND regexp_matches({q.up("label")},
            'LINE|STATEMENT|LOGOGRAM'))
          AND {q.up("label")} NOT IN ('LINE','STATEMENT','LOGOGRAM','NUMBER','FRACTION','SIDE',
            'SIDE.LINE')),
      k AS (SELECT *, coalesce(nullif({q.collapse(f"replace({q.clean('label')}, '•', ' ')")}, ''),
            'table' || t || '_row' || r) AS line FROM b),
      p AS (SELECT page_id, s, t, r, artifact_id, line || '_stmt' AS line_id, cells[2] AS cell FROM k
        UNION ALL SELECT page_id, s, t, r, artifact_id, line || '_log', cells[3] FROM k
          WHERE len(cells) >= 3),
      f AS (SELECT *, {q.canonical("cell")} AS sign_sequence FROM p),
      g AS (SELECT *, {q.toks("sign_sequence")} AS tk FROM f)
    SELECT page_id, s::INT AS s, t::INT AS t, r::INT AS r, artifact_id, line_id, sign_sequence
    FROM g WHERE {q.plausible("tk")}""",
)
def src_html_table_rows(spark, sf):
    return pages.table_rows(
        _pages(spark, sf),
        "page_id",
        "html",
        heading="<!-- (.*?) -->",
        table=r"(?is)<article[^>]*>(.*?)</article>",
        row=r"(?is)<p[^>]*>(.*?)</p>",
        cell=SENTENCE,
    )


PAGE_TITLE_SQL = "regexp_extract(html, '<title>([^<]+)</title>', 1)"


@query(
    "src_link_pattern_sequences",
    f"""WITH h AS (SELECT page_id,
          {q.collapse(f"regexp_replace({q.up(q.clean(PAGE_TITLE_SQL))}, '[^A-Z0-9 ]+', ' ', 'g')")}
          AS artifact_id, regexp_extract_all(html, 'href="/([^"]+)"', 1) AS ls FROM pages),
      l AS (SELECT page_id, artifact_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS x FROM h),
      c AS (SELECT page_id, artifact_id, i, {q.canonical("x")} AS sign_sequence FROM l),
      w AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS n,
          {q.toks("sign_sequence")} AS tk FROM c WHERE sign_sequence <> '')
    SELECT page_id, artifact_id, 'word_' || n AS line_id, sign_sequence FROM w
    WHERE {q.plausible("tk")}""",
)
def src_link_pattern_sequences(spark, sf):
    return pages.link_sequences(
        _pages(spark, sf),
        "page_id",
        "html",
        pattern='href="/([^"]+)"',
        title="<title>([^<]+)</title>",
        catalog_only=False,
    )


@query(
    "src_document_links",
    """SELECT DISTINCT unnest(regexp_extract_all(html, 'href="(/[^"]+)"', 1)) AS path
    FROM pages ORDER BY path""",
)
def src_document_links(spark, sf):
    return pages.document_links(_pages(spark, sf), "html", 'href="(/[^"]+)"')


def scratch_root(spark) -> str:
    """A fresh folder beside the checkpoints, on storage that executors share."""
    return f"{checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}"


@query(
    "sink_tables",
    f"""WITH {q.EV} SELECT sign, count(*) AS count, 'r1' AS run_id
    FROM (SELECT unnest(signs) AS sign FROM ev) GROUP BY sign""",
)
def sink_tables(spark, sf):
    signs = corpora.event_lines(spark, sf).select(F.explode("signs").alias("sign"))
    counts = signs.groupBy("sign").agg(F.count(F.lit(1)).alias("count"))
    root = scratch_root(spark)
    sinks.write_table(counts, root, "sign_counts", "r1", ["sign", "count"])
    return sinks.read_table(spark, root, "sign_counts", "r1")


@query(
    "sink_run_summary",
    f"""WITH {q.EV} SELECT count(*) AS canonical_entries,
      count(DISTINCT artifact_id) AS artifact_count, 'r1' AS run_id FROM ev""",
)
def sink_run_summary(spark, sf):
    lines = corpora.event_lines(spark, sf)
    summary = lines.agg(
        F.count(F.lit(1)).alias("canonical_entries"),
        F.count_distinct("artifact_id").alias("artifact_count"),
    )
    root = scratch_root(spark)
    target = sinks.write_summary(summary, root, "r1")
    schema = "canonical_entries bigint, artifact_count bigint, run_id string"
    return spark.read.schema(schema).json(target)
