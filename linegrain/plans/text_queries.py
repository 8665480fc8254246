"""Scalar text rules over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from linegrain.checks import corpus_sql as q
from linegrain.functions import text as tx
from linegrain.plans.registry import query
from linegrain.sources import corpora


def _lines(spark, sf):
    docs = corpora.table(spark, sf, "documents")
    return corpora.text_lines(docs, "doc_id", "text", "lang", "source")


def _pages(spark, sf):
    return corpora.table(spark, sf, "pages")


def _over_lines(expr: str) -> str:
    return f"WITH {q.RAW_DOCS} SELECT doc_id, line_no::INT AS line_no, {expr} FROM raw_docs"


@query(
    "fn_split_quantity",
    _over_lines(f"{q.surface('line')} AS surface, {q.quantity('line')} AS quantity, {q.digits('line')} AS digits"),
)
def fn_split_quantity(spark, sf):
    line = F.col("line")
    return _lines(spark, sf).select(
        "doc_id",
        "line_no",
        tx.surface_part(line).alias("surface"),
        tx.quantity_part(line).alias("quantity"),
        tx.quantity_digits(line).alias("digits"),
    )


@query(
    "fn_tokens",
    _over_lines(f"array_to_string({q.toks('line')}, ' ') AS signs, len({q.toks('line')}) AS n"),
)
def fn_tokens(spark, sf):
    signs = tx.tokens(F.col("line"))
    return _lines(spark, sf).select(
        "doc_id", "line_no", F.array_join(signs, " ").alias("signs"), F.size(signs).alias("n")
    )


_GROUPS = rf"regexp_extract_all({q.up('line')}, '\S+')"


@query(
    "fn_groups",
    _over_lines(f"array_to_string({_GROUPS}, ' ') AS word_groups, len({_GROUPS}) AS n"),
)
def fn_groups(spark, sf):
    words = tx.groups(F.col("line"))
    return _lines(spark, sf).select(
        "doc_id",
        "line_no",
        F.array_join(words, " ").alias("word_groups"),
        F.size(words).alias("n"),
    )


@query("fn_clean_html", f"SELECT page_id, {q.clean('html')} AS cleaned FROM pages")
def fn_clean_html(spark, sf):
    return _pages(spark, sf).select("page_id", tx.clean_html(F.col("html")).alias("cleaned"))


@query(
    "fn_artifact_key",
    "SELECT page_id, "
    + q.collapse(f"regexp_replace({q.up(q.clean('url'))}, '[^A-Z0-9 ]+', ' ', 'g')")
    + " AS artifact_key FROM pages",
)
def fn_artifact_key(spark, sf):
    return _pages(spark, sf).select("page_id", tx.artifact_key(F.col("url")).alias("artifact_key"))


@query(
    "fn_line_key",
    _over_lines(
        "coalesce(nullif("
        + q.collapse(f"replace({q.clean('line')}, '•', ' ')")
        + ", ''), 'row_' || line_no) AS line_key"
    ),
)
def fn_line_key(spark, sf):
    fallback = F.concat(F.lit("row_"), "line_no")
    return _lines(spark, sf).select(
        "doc_id", "line_no", tx.line_key(F.col("line"), fallback).alias("line_key")
    )


@query("fn_canonical_sequence", _over_lines(f"{q.canonical('line')} AS canonical"))
def fn_canonical_sequence(spark, sf):
    return _lines(spark, sf).select(
        "doc_id", "line_no", tx.canonical_sequence(F.col("line")).alias("canonical")
    )


@query(
    "fn_token_shape_ok",
    f"""WITH {q.RAW_DOCS}, t AS (SELECT unnest({q.toks("line")}) AS token FROM raw_docs)
    SELECT token, count(*) AS n, regexp_matches(token, '{q.SHAPE}') AS shape_ok
    FROM t GROUP BY token""",
)
def fn_token_shape_ok(spark, sf):
    toks = _lines(spark, sf).select(F.explode(tx.tokens(F.col("line"))).alias("token"))
    counted = toks.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("shape_ok", tx.shape_ok(F.col("token")))


@query(
    "fn_plausible_sequence",
    f"""WITH {q.RAW_DOCS}, t AS (SELECT doc_id, line_no, {q.toks(q.canonical("line"))} AS t
      FROM raw_docs)
    SELECT doc_id, line_no::INT AS line_no, {q.plausible("t")} AS plausible FROM t""",
)
def fn_plausible_sequence(spark, sf):
    toks = _lines(spark, sf).select(
        "doc_id", "line_no", tx.tokens(tx.canonical_sequence(F.col("line"))).alias("t")
    )
    return toks.select("doc_id", "line_no", tx.plausible(F.col("t")).alias("plausible"))


@query(
    "fn_catalog_sequence",
    rf"""WITH t AS (SELECT p_partkey, string_split(upper(replace(p_brand, '#', '')
          || ' A' || p_size || ' ' || p_type), ' ') AS t FROM part)
    SELECT p_partkey, len(t) > 0
      AND NOT list_has_any(t, ['NO','OF','IMPRESSIONS','FRACTION','SIGN','SIGNS'])
      AND len(list_filter(t, lambda x: NOT regexp_matches(x,
        '^[\[\]]*(\?|(AB|A)[0-9]+[A-Z0-9?]*|\*[0-9]+[A-Z0-9?]*)[\[\]]*$'))) = 0 AS whole_ok,
      len(list_filter(t, lambda x: regexp_matches(x,
        '^[\[\]]*(\?|(AB|A)[0-9]+[A-Z0-9?]*|\*[0-9]+[A-Z0-9?]*)[\[\]]*$'))) > 0
        AS size_code_ok FROM t""",
)
def fn_catalog_sequence(spark, sf):
    code = F.concat(
        F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(" A"), "p_size", F.lit(" "), "p_type"
    )
    toks = corpora.table(spark, sf, "part").select("p_partkey", tx.tokens(code).alias("t"))
    return toks.select(
        "p_partkey",
        tx.catalog_sequence(F.col("t")).alias("whole_ok"),
        F.exists("t", lambda t: tx.catalog_sequence(F.array(t))).alias("size_code_ok"),
    )


@query(
    "fn_slug",
    f"""SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(url)),
      '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'external') AS slug FROM pages""",
)
def fn_slug(spark, sf):
    return _pages(spark, sf).select("page_id", tx.slug(F.col("url")).alias("slug"))


@query(
    "fn_ngrams",
    f"""WITH {q.DOC}, g AS (SELECT line_id, signs, generate_series(1, len(signs) - 2) AS s FROM doc)
    SELECT line_id, array_to_string(list_transform(s, lambda i:
      array_to_string(signs[i:i+2], ' ')), ', ') AS trigrams, len(s) AS n FROM g""",
)
def fn_ngrams(spark, sf):
    grams = tx.ngrams(F.col("signs"), 3)
    return corpora.document_lines(spark, sf).select(
        "line_id", F.array_join(grams, ", ").alias("trigrams"), F.size(grams).alias("n")
    )
