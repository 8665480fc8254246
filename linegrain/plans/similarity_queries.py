"""Similar event sequences and their clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from linegrain.checks import corpus_sql as q
from linegrain.operators import components as cc
from linegrain.operators import similarity as sm
from linegrain.operators import templates as tp
from linegrain.plans.profile_queries import TYPES
from linegrain.plans.registry import query
from linegrain.session import cut
from linegrain.sources import corpora

# All pairs, scored by the definition: what the join must equal. The LCS uses
# the same word-sized state, in SQL.
_POS = "generate_series(1, least(len(a.signs), len(b.signs)))"
EDGES = f"""bits AS (SELECT seq_no, sign, bit_or(1::BIGINT << (i - 1)::INT)::BIGINT AS mask FROM (
      SELECT seq_no, generate_subscripts(signs, 1) AS i, unnest(signs) AS sign FROM types)
    GROUP BY seq_no, sign),
  maps AS (SELECT seq_no, map(list(sign), list(mask)) AS masks FROM bits GROUP BY seq_no),
  t2 AS (SELECT types.*, masks, (1::BIGINT << len(signs)::INT) - 1 AS full_ FROM types
    JOIN maps USING (seq_no)),
  raw AS (SELECT a.seq_no AS seq_no_a, b.seq_no AS seq_no_b, a.sequence AS sequence_a,
      b.sequence AS sequence_b, greatest(len(a.signs), len(b.signs))::DOUBLE AS m,
      len(a.signs) - bit_count(list_reduce(
        list_prepend(a.full_, list_transform(b.signs, lambda t: coalesce(a.masks[t], 0))),
        lambda s, k: ((s + (s & k)) | (s - (s & k))) & a.full_)) AS lcs,
      coalesce(list_position(list_transform({_POS}, lambda i: a.signs[i] = b.signs[i]), false) - 1,
        least(len(a.signs), len(b.signs))) AS p,
      coalesce(list_position(list_transform({_POS}, lambda i: a.signs[-i] = b.signs[-i]), false)
        - 1, least(len(a.signs), len(b.signs))) AS s,
      len(list_intersect(a.signs, b.signs))::DOUBLE
        / len(list_distinct(list_concat(a.signs, b.signs))) AS j
    FROM t2 a JOIN t2 b ON a.seq_no < b.seq_no),
  edges AS (SELECT *, 0.4::DOUBLE * (lcs / m) + 0.2::DOUBLE * (p / m) + 0.2::DOUBLE * (s / m)
      + 0.2::DOUBLE * j AS similarity FROM raw
    WHERE 0.4::DOUBLE * (lcs / m) + 0.2::DOUBLE * (p / m) + 0.2::DOUBLE * (s / m)
      + 0.2::DOUBLE * j >= 0.5)"""


@query(
    "seq_similarity_join",
    f"""WITH {q.EV}, {TYPES}, {EDGES} SELECT printf('SEQ_%03d', seq_no_a) AS seq_id_a, sequence_a,
      printf('SEQ_%03d', seq_no_b) AS seq_id_b, sequence_b, round(similarity, 6) AS similarity
    FROM edges""",
)
def seq_similarity_join(spark, sf):
    pairs = sm.similar_pairs(tp.sequence_types(corpora.event_lines(spark, sf)))
    return pairs.select(
        F.format_string("SEQ_%03d", "seq_no_a").alias("seq_id_a"),
        F.array_join("signs_a", " ").alias("sequence_a"),
        F.format_string("SEQ_%03d", "seq_no_b").alias("seq_id_b"),
        F.array_join("signs_b", " ").alias("sequence_b"),
        F.round("similarity", 6).alias("similarity"),
    )


@query(
    "seq_clusters",
    f"""WITH RECURSIVE {q.EV}, {TYPES}, {EDGES},
    und AS MATERIALIZED (SELECT seq_no_a AS u, seq_no_b AS v FROM edges
      UNION ALL SELECT seq_no_b, seq_no_a FROM edges),
    lab(node, root) USING KEY (node) AS (
      SELECT seq_no, seq_no FROM types
      UNION SELECT und.v, min(lab.root) FROM lab JOIN und ON und.u = lab.node
        JOIN recurring.lab old ON old.node = und.v WHERE lab.root < old.root GROUP BY und.v),
    sz AS (SELECT root, count(*) AS cluster_size,
        row_number() OVER (ORDER BY count(*) DESC, root) AS no FROM lab GROUP BY root)
    SELECT printf('CL_%03d', no) AS cluster_id, printf('SEQ_%03d', seq_no) AS sequence_id,
      sequence, line_frequency, len(signs)::INT AS sequence_length, artifact_count, cluster_size
    FROM types JOIN lab ON node = seq_no JOIN sz USING (root)""",
)
def seq_clusters(spark, sf):
    types = cut(tp.sequence_types(corpora.event_lines(spark, sf)))
    found = cc.clusters(types, sm.similar_pairs(types))
    return found.select(
        "cluster_id",
        "sequence_id",
        F.array_join("signs", " ").alias("sequence"),
        "line_frequency",
        "sequence_length",
        "artifact_count",
        "cluster_size",
    )
