"""The registered queries of this folder: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linegrain.llm import blocks, fixity, hnsw, manifest, mixing, neardup, packing, quality, repeats, reuse, tokenfile, trie, urllists
from linegrain.plans.registry import Query

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query
def op1_sharded_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(_table(spark, sf_dir, "embeddings"))


@_query
def op2_block_tree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blocks.extract(_table(spark, sf_dir, "pages"), carry=["page_id", "url"])
    return found.select("_row.page_id", "_row.url", "text", "n_chars")


@_query
def op3_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


@_query
def op4_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select("_row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


ORACLES["op5_merkle_audit"] = r"""
WITH d AS (SELECT doc_id, source, substr(md5(doc_id::VARCHAR), 1, 2) AS h FROM documents)
SELECT '{"s":"' || source || '"}' AS shard, doc_id AS "offset",
  CASE h WHEN '00' THEN 'changed' WHEN '01' THEN 'missing' ELSE 'extra' END AS state
FROM d WHERE h IN ('00', '01', '02')"""


@_query
def op5_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as records, against a replica that is damaged where the hash of an id says so."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mark = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 2)
    damaged = F.when(mark == "00", F.concat(F.coalesce("text", F.lit("")), F.lit("\0"))).otherwise(F.col("text"))
    one = docs.where(mark != "02")
    two = docs.where(mark != "01").withColumn("text", damaged)
    return fixity.audit(one, two, "source", "doc_id", "text")


ORACLES["op6_lists_as_of"] = r"""
WITH captures AS (
  SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
    DATE '2024-01-01' + (page_id % 365)::INT AS day FROM pages),
entries AS (
  SELECT CASE WHEN page_id % 5 = 0 THEN regexp_replace(host, '^[^.]+\.', '') ELSE host END AS domain,
    DATE '2024-01-01' + (page_id * 7 % 365)::INT AS day, page_id % 3 <> 1 AS listed FROM captures),
daily AS (SELECT domain, day, bool_or(listed) AS listed FROM entries GROUP BY ALL),
spans AS (
  SELECT domain, day AS since, listed, COALESCE(LEAD(day) OVER (PARTITION BY domain ORDER BY day), DATE '9999-12-31') AS until
  FROM daily),
hits AS (
  SELECT c.page_id, COUNT(*) AS n FROM captures c JOIN spans s
    ON s.listed AND c.day >= s.since AND c.day < s.until
    AND (c.host = s.domain OR (c.host LIKE '%.' || s.domain AND s.domain LIKE '%.%')) GROUP BY 1)
SELECT c.page_id, c.url, c.host, COALESCE(h.n, 0)::BIGINT AS n_listed, COALESCE(h.n, 0) > 0 AS blocked
FROM captures c LEFT JOIN hits h USING (page_id)"""


@_query
def op6_lists_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch days and one dated entry a page come from page_id, because pages hold no dates."""
    first = F.to_date(F.lit("2024-01-01"))
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("day", F.date_add(first, (F.col("page_id") % 365).cast("int")))
    site = urllists.host("url")
    entries = pages.select(
        F.when(F.col("page_id") % 5 == 0, F.regexp_replace(site, r"^[^.]+\.", "")).otherwise(site).alias("domain"),
        F.date_add(first, (F.col("page_id") * 7 % 365).cast("int")).alias("day"),
        (F.col("page_id") % 3 != 1).alias("listed"),
    )
    found = urllists.as_of(captures, entries)
    return found.select("_row.page_id", "_row.url", "host", "n_listed", "blocked")


@_query
def op7_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=2)


ORACLES["op8_source_mix"] = r"""
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5('mix-1:' || doc_id::VARCHAR), 1, 16) AS k
  FROM documents),
sources AS (
  SELECT source, SUM(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, list_extract([5, 2, 1], (((ROW_NUMBER() OVER (ORDER BY source IS NULL, source)) - 1) % 3 + 1)::INT) AS weight
  FROM sources),
held AS (
  SELECT *, 3.0 * source_size / weight AS ratio FROM weighed),
levels AS (
  SELECT h.ratio,
    ((SELECT SUM(source_size) FROM held) - COALESCE((SELECT SUM(3 * source_size) FROM held b WHERE b.ratio < h.ratio), 0))::DOUBLE
    / (SELECT SUM(weight) FROM held b WHERE b.ratio >= h.ratio)::DOUBLE AS level
  FROM held h),
chosen AS (
  SELECT level FROM levels WHERE level <= ratio ORDER BY ratio LIMIT 1),
shares AS (
  SELECT source, source_size, LEAST(3.0 * source_size, (SELECT level FROM chosen) * weight)::DOUBLE AS target FROM held),
run AS (
  SELECT d.doc_id, d.size, s.source_size, s.target, floor(s.target)::BIGINT AS budget,
    COALESCE(SUM(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
    + GREATEST(0, LEAST(size, budget - (budget // source_size) * source_size - before)) END::BIGINT AS taken
FROM run"""


@_query
def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@_query
def op9_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    measured = quality.measure(docs, carry=["doc_id", "lang"])
    judged = quality.judge(measured, F.col("_row.lang"))
    return judged.select(
        "_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "chars_per_token", "byte_share", "token_entropy",
    )


@_query
def op10_simple8b_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.read_checks(tokenfile.write_token_files(_table(spark, sf_dir, "documents")))


@_query
def op11_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reuse.encode_decode(_table(spark, sf_dir, "documents"))


def _crc32(value: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    return f"""xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT],
      flatten(list_transform(range(1, length({value}) + 1), lambda i:
        [ascii(substr({value}, i::INT, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384::BIGINT)))"""


def _framed(*values: str) -> str:
    return " || ".join(f"COALESCE(strlen({v})::VARCHAR || ':' || {v}, '-')" for v in values)


_PLAIN = ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR")
_LOWERED = f"translate(text, '{manifest.UPPER}', '{manifest.LOWER}')"

ORACLES["op12_merkle_climb"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, sha256({_framed(*_PLAIN, "text")}) AS leaf,
    CASE WHEN {_crc32("doc_id::VARCHAR")} % 3 = 0 THEN sha256({_framed(*_PLAIN, _LOWERED)})
      ELSE sha256({_framed(*_PLAIN, "text")}) END AS shown FROM documents),
n AS (
  SELECT doc_id, leaf, shown, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY lang) AS size,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, shown) - 1 AS pos FROM d),
lv AS (
  SELECT tree, 0 AS level, pos, size, leaf AS digest FROM n
  UNION ALL
  SELECT tree, level + 1, pos // 8, (max(size) + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos))
  FROM lv WHERE size > 1 GROUP BY tree, level, pos // 8),
sub AS (SELECT tree, digest AS subroot FROM lv WHERE size = 1),
cw AS (
  SELECT 0 AS level, tree AS pos, (SELECT count(*) FROM sub) AS size, subroot AS digest FROM sub
  UNION ALL
  SELECT level + 1, pos // 8, (max(size) + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos))
  FROM cw WHERE size > 1 GROUP BY level, pos // 8),
nodes AS (
  SELECT tree, level, pos, digest, size FROM lv WHERE size > 1
  UNION ALL SELECT -1, level, pos, digest, size FROM cw WHERE size > 1),
sib AS (
  SELECT a.tree AS at, a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.pos // 8 = b.pos // 8 GROUP BY ALL),
climb AS (
  SELECT doc_id, leaf, tree, tree AS at, 0 AS level, pos, size, shown AS folded, '' AS proof FROM n
  UNION ALL
  SELECT doc_id, leaf, tree, CASE WHEN size > 1 THEN c.at ELSE -1 END, CASE WHEN size > 1 THEN c.level + 1 ELSE 0 END,
    CASE WHEN size > 1 THEN c.pos // 8 ELSE tree END,
    CASE WHEN size > 1 THEN (size + 7) // 8 ELSE (SELECT count(*) FROM sub) END,
    CASE WHEN size > 1 THEN sha256(l || folded || r) ELSE folded END, CASE WHEN size > 1 THEN proof || l || r ELSE proof END
  FROM climb c LEFT JOIN sib s ON s.at = c.at AND s.level = c.level AND s.pos = c.pos WHERE NOT (size = 1 AND c.at = -1))
SELECT doc_id, leaf, subroot, cw.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
  folded = cw.digest AS verified
FROM climb JOIN sub USING (tree), cw WHERE climb.at = -1 AND climb.size = 1 AND cw.size = 1"""


@_query
def op12_merkle_climb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verify(_table(spark, sf_dir, "documents"))


ORACLES["op13_prefix_trie"] = rf"""
WITH t AS (
  SELECT conv_id, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS said,
    len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
h AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, {_crc32("conv_id::VARCHAR")} % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT h.conv_id, pos, said, words FROM h JOIN t ON t.conv_id = base AND pos < h
  UNION ALL SELECT conv_id, pos, said, words FROM h JOIN t USING (conv_id) WHERE pos >= h),
c AS (
  SELECT conv_id, coalesce(list(said ORDER BY pos) FILTER (said IS NOT NULL), []) AS s,
    coalesce(list(words ORDER BY pos) FILTER (said IS NOT NULL), []) AS w FROM h LEFT JOIN r USING (conv_id) GROUP BY conv_id),
m AS (SELECT conv_id, s, w, unnest(range(0, len(s) + 1)) AS depth FROM c),
n AS (
  SELECT depth, array_to_string(s[1:depth], ' ') AS k, array_to_string(s[1:greatest(depth - 1, 0)], ' ') AS up, min(conv_id) AS conv_id,
    count(*) AS n_convs, any_value(CASE WHEN depth = 0 THEN 0 ELSE w[depth] END) AS words, any_value(s[1:depth]) AS path,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(s) = depth), '')) AS ends_sha256
  FROM m GROUP BY ALL),
kids AS (SELECT depth - 1 AS depth, up AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
v AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, (n_children IS NULL)::BIGINT AS leaf, (n_convs - 1) * words AS own
  FROM n LEFT JOIN kids USING (depth, k)),
a AS (SELECT unnest(range(0, depth + 1)) AS depth, path, leaf, own FROM v),
sums AS (
  SELECT depth, array_to_string(path[1:depth], ' ') AS k, sum(leaf)::BIGINT AS n_leaves, sum(own)::BIGINT AS saved_tokens
  FROM a GROUP BY ALL)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256
FROM v JOIN sums USING (depth, k) LEFT JOIN v p ON p.depth = v.depth - 1 AND p.k = v.up"""


@_query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(_table(spark, sf_dir, "conversations"))
