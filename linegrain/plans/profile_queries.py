"""Frequency profiles of document lines; types and templates of event lines."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from linegrain.checks import corpus_sql as q
from linegrain.operators import profiles as pf
from linegrain.operators import templates as tp
from linegrain.plans.registry import query
from linegrain.sources import corpora


def _share_sql(name: str, items: str) -> str:
    return f"""WITH {q.DOC}, x AS (SELECT unnest({items}) AS {name} FROM doc)
    SELECT {name}, count(*) AS count,
      round(count(*) / sum(count(*)) OVER (), 6) AS relative_frequency FROM x GROUP BY {name}"""


def _grams(n: int) -> str:
    step = " || ' ' || ".join(f"signs[i + {k}]" for k in range(n))
    return f"list_transform(generate_series(1, len(signs) - {n - 1}), lambda i: {step})"


@query("freq_unigram", _share_sql("sign", "signs"))
def freq_unigram(spark, sf):
    return pf.ngram_frequency(corpora.document_lines(spark, sf), 1, "sign")


@query("freq_bigram", _share_sql("bigram", _grams(2)))
def freq_bigram(spark, sf):
    return pf.ngram_frequency(corpora.document_lines(spark, sf), 2, "bigram")


@query("freq_trigram", _share_sql("trigram", _grams(3)))
def freq_trigram(spark, sf):
    return pf.ngram_frequency(corpora.document_lines(spark, sf), 3, "trigram")


@query("freq_initial", _share_sql("sign", "[signs[1]]"))
def freq_initial(spark, sf):
    return pf.edge_frequency(corpora.document_lines(spark, sf))


@query("freq_terminal", _share_sql("sign", "[signs[-1]]"))
def freq_terminal(spark, sf):
    return pf.edge_frequency(corpora.document_lines(spark, sf), terminal=True)


def _edge_sql(name: str, cut: str) -> str:
    return f"""{q.DOC}, e AS (SELECT artifact_id, array_to_string({cut}, ' ') AS {name}, n AS length
      FROM (SELECT artifact_id, signs, unnest(generate_series(1, least(3, len(signs)))) AS n
        FROM doc)),
    pat AS (SELECT {name}, length::INT AS length, count(*) AS count,
        count(DISTINCT artifact_id) AS artifact_count FROM e GROUP BY {name}, length
      HAVING count(*) >= 2)"""


def _edge_artifacts_sql(name: str, cut: str) -> str:
    return f"""WITH {_edge_sql(name, cut)}, d AS (SELECT DISTINCT {name}, length::INT AS length,
        artifact_id FROM e JOIN pat USING ({name}, length)),
      r AS (SELECT *, ((row_number() OVER (PARTITION BY {name}, length ORDER BY artifact_id) - 1)
        // 1000)::INT AS page FROM d)
    SELECT {name}, length, page, string_agg(artifact_id, ',' ORDER BY artifact_id) AS items,
      count(*) AS item_count FROM r GROUP BY {name}, length, page"""


PREFIX, SUFFIX = "signs[1:n]", "signs[len(signs) - n + 1:]"


@query("prefix_patterns", f"WITH {_edge_sql('prefix', PREFIX)} SELECT * FROM pat")
def prefix_patterns(spark, sf):
    return pf.edge_patterns(corpora.document_lines(spark, sf))


@query("prefix_pattern_artifacts", _edge_artifacts_sql("prefix", PREFIX))
def prefix_pattern_artifacts(spark, sf):
    return pf.edge_pattern_artifacts(corpora.document_lines(spark, sf))


@query("suffix_patterns", f"WITH {_edge_sql('suffix', SUFFIX)} SELECT * FROM pat")
def suffix_patterns(spark, sf):
    return pf.edge_patterns(corpora.document_lines(spark, sf), suffix=True)


@query("suffix_pattern_artifacts", _edge_artifacts_sql("suffix", SUFFIX))
def suffix_pattern_artifacts(spark, sf):
    return pf.edge_pattern_artifacts(corpora.document_lines(spark, sf), suffix=True)


TYPES = """types AS (SELECT *, row_number() OVER (ORDER BY line_frequency DESC, len(signs), signs)
    AS seq_no, array_to_string(signs, ' ') AS sequence FROM (
  SELECT signs, count(*) AS line_frequency, count(DISTINCT artifact_id) AS artifact_count
  FROM ev GROUP BY signs))"""


@query(
    "seq_types",
    f"""WITH {q.EV}, {TYPES} SELECT printf('SEQ_%03d', seq_no) AS sequence_id, seq_no, sequence,
      line_frequency, len(signs)::INT AS sequence_length, artifact_count FROM types""",
)
def seq_types(spark, sf):
    types = tp.sequence_types(corpora.event_lines(spark, sf))
    return types.withColumn("sequence", F.array_join("signs", " ")).drop("signs")


@query(
    "seq_type_artifacts",
    f"""WITH {q.EV}, d AS (SELECT DISTINCT array_to_string(signs, ' ') AS sequence, artifact_id
      FROM ev), r AS (SELECT *, ((row_number() OVER (PARTITION BY sequence ORDER BY artifact_id)
        - 1) // 1000)::INT AS page FROM d)
    SELECT sequence, page, string_agg(artifact_id, ',' ORDER BY artifact_id) AS items,
      count(*) AS item_count FROM r GROUP BY sequence, page""",
)
def seq_type_artifacts(spark, sf):
    return tp.sequence_type_artifacts(corpora.event_lines(spark, sf))


def templates_sql(source: str, share: float, tag: str = "") -> str:
    """The tables of the templates of ``source``; ``tag`` ends their names, so that several can stand together."""
    return re.sub(r"\b(sz|tpc|top|sl|tr|cv|tmpl)\b", rf"\1{tag}", _templates_sql(source, share))


def _templates_sql(source: str, share: float) -> str:
    return f"""sz AS (SELECT len(signs) AS length, count(*) AS lines FROM {source} GROUP BY 1
      HAVING count(*) >= 2),
    tpc AS (SELECT length, position, token, count(*) AS n FROM (SELECT len(signs) AS length,
        generate_subscripts(signs, 1) AS position, unnest(signs) AS token FROM {source})
      GROUP BY ALL),
    top AS (SELECT length, position, first(token ORDER BY n DESC, token) AS token, max(n) AS n
      FROM tpc GROUP BY length, position),
    sl AS (SELECT length, lines, list(CASE WHEN n / lines >= {share} AND n >= 2 THEN token ELSE '*'
        END ORDER BY position) AS slots FROM top JOIN sz USING (length) GROUP BY length, lines),
    tr AS (SELECT * FROM sl WHERE len(list_filter(slots, lambda s: s <> '*')) > 0),
    cv AS (SELECT tr.length, count(*) FILTER (len(list_filter(list_zip(s.signs, slots),
        lambda p: p[2] <> '*' AND p[1] <> p[2])) = 0) AS matching
      FROM {source} s JOIN tr ON len(s.signs) = tr.length GROUP BY tr.length),
    tmpl AS (SELECT length::INT AS sequence_length, array_to_string(slots, ' ') AS template,
        len(list_filter(slots, lambda s: s <> '*'))::INT AS fixed_positions,
        lines AS entries_in_length_group, round(matching / lines, 6) AS coverage
      FROM tr JOIN cv USING (length))"""


# Five event types are nearly equally common, so a slot counts as fixed from a fifth up.
EVENT_SHARE = 0.21


@query(
    "seq_templates", f"WITH {q.EV}, {templates_sql('ev', EVENT_SHARE)} SELECT * FROM tmpl"
)
def seq_templates(spark, sf):
    return tp.templates(corpora.event_lines(spark, sf), EVENT_SHARE)


@query(
    "template_weighted_coverage",
    f"""WITH {q.EV}, {templates_sql("ev", EVENT_SHARE)}
    SELECT round(sum(coverage * entries_in_length_group) / sum(entries_in_length_group), 6)
        AS coverage_of_template_lines,
      round(sum(coverage * entries_in_length_group) / (SELECT count(*) FROM ev), 6)
        AS coverage_of_all_lines FROM tmpl""",
)
def template_weighted_coverage(spark, sf):
    lines = corpora.event_lines(spark, sf)
    return tp.weighted_coverage(lines, tp.templates(lines, EVENT_SHARE))
