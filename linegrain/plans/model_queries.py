"""Tests, metrics, models and cross-validation over event lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from linegrain.checks import corpus_sql as q
from linegrain.operators import classify as cl
from linegrain.operators import cv
from linegrain.operators import models as md
from linegrain.operators import stats as st
from linegrain.plans.registry import query
from linegrain.session import cut
from linegrain.sources import corpora

TOKEN, LENGTH, POSITION = "PURCHASE", 4, 3


def subset_sql(source: str = "ev", token: str = TOKEN) -> str:
    return f"""sub AS (SELECT len(list_filter(signs, lambda t: t = '{token}')) AS k,
    signs[{POSITION}] = '{token}' AS hit FROM {source}
  WHERE len(signs) = {LENGTH} AND list_contains(signs, '{token}'))"""


_SUBSET = subset_sql()


@query(
    "test_position_expectation",
    f"""WITH {q.EV}, {_SUBSET} SELECT count(*) AS observed_total,
      count(*) FILTER (hit) AS observed_count,
      round(sum(k) / {LENGTH}, 6) AS expected_mean_under_null FROM sub""",
)
def test_position_expectation(spark, sf):
    return st.position_expectation(corpora.event_lines(spark, sf), TOKEN, LENGTH, POSITION)


# The tail by convolution: one binomial for each number of tokens in a line, summed over all splits of the hits.
def tail_sql(source: str = "ev", token: str = TOKEN) -> str:
    """One-row table ``tail`` with the chance of at least the observed hits; lines of LENGTH have one to four tokens."""
    chance = f"""exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(k / {LENGTH}::DOUBLE)
      + (n - j) * ln(1 - k / {LENGTH}::DOUBLE))"""
    return f"""{subset_sql(source, token)},
  ks AS (SELECT c.k, count(s.k) AS n FROM (SELECT unnest(range(1, {LENGTH} + 1)) AS k) c LEFT JOIN sub s ON s.k = c.k GROUP BY c.k),
  pmf AS (SELECT k, j, CASE WHEN k = {LENGTH} THEN (j = n)::INT::DOUBLE ELSE {chance} END AS p
    FROM (SELECT k, n, unnest(range(0, n + 1)) AS j FROM ks)),
  obs AS (SELECT count(*) AS observed_total, count(*) FILTER (hit) AS observed_count,
    round(coalesce(sum(k), 0) / {LENGTH}, 6) AS expected_mean_under_null FROM sub),
  few AS (SELECT b.j + c.j + d.j AS j, sum(b.p * c.p * d.p) AS p FROM pmf b, pmf c, pmf d
    WHERE b.k = 2 AND c.k = 3 AND d.k = 4 AND d.p > 0 GROUP BY 1),
  atleast AS (SELECT j, sum(p) OVER (ORDER BY j DESC) AS p FROM pmf WHERE k = 1),
  tail AS (SELECT observed_total, observed_count, expected_mean_under_null, CASE WHEN observed_total = 0 THEN 1 ELSE
      ({st.ROUNDS} * (SELECT coalesce(sum(few.p * CASE WHEN observed_count <= few.j THEN 1 ELSE coalesce(a.p, 0) END), 0)
        FROM few LEFT JOIN atleast a ON a.j = observed_count - few.j) + 1) / {st.ROUNDS + 1} END AS p_value_ge_observed
    FROM obs)"""


@query(
    "test_position_permutation",
    f"""WITH {q.EV}, {tail_sql()} SELECT observed_total, observed_count, expected_mean_under_null,
      round(p_value_ge_observed, 6) AS p_value_ge_observed FROM tail""",
)
def test_position_permutation(spark, sf):
    tested = st.position_test(corpora.event_lines(spark, sf), TOKEN, LENGTH, POSITION)
    return tested.withColumn("p_value_ge_observed", F.round("p_value_ge_observed", 6))


def stems_sql(source: str = "ev") -> str:
    return f"""stems AS (SELECT signs[1] || ' ' || signs[2] AS stem,
    array_to_string(signs, ' ') AS form, coalesce(signs[3], '<ZERO>') AS ending, artifact_id
  FROM {source} WHERE len(signs) >= 2),
  stem_rows AS (SELECT stem, count(DISTINCT form) AS form_count,
    count(DISTINCT ending) AS ending_count, count(*) AS line_count,
    count(DISTINCT artifact_id) AS artifact_count FROM stems GROUP BY stem)"""


_STEMS = stems_sql()


def stem_support_sql(source: str = "ev") -> str:
    return f"""round(least(78.0::DOUBLE, 100.0::DOUBLE *
      (0.5::DOUBLE * least(1.0::DOUBLE, ending_count / 5.0::DOUBLE)
      + 0.3::DOUBLE * (line_count / (SELECT count(*) FROM {source}))
      + 0.2::DOUBLE * (artifact_count / (SELECT count(DISTINCT artifact_id) FROM {source})))), 6)"""


PIVOT_SUPPORT = """round(least(84.0::DOUBLE, 100 * (0.45::DOUBLE * observed_count / greatest(1, observed_total)
        + 0.3::DOUBLE * (1 - p_value_ge_observed) + 0.25::DOUBLE * least(1, observed_total / 12))), 6)"""


@query("test_stem_endings", f"WITH {q.EV}, {_STEMS} SELECT * FROM stem_rows")
def test_stem_endings(spark, sf):
    return st.stem_endings(corpora.event_lines(spark, sf))


@query(
    "test_stem_ending_lists",
    f"""WITH {q.EV}, {_STEMS} SELECT stem, 0 AS page,
      string_agg(DISTINCT ending, ',' ORDER BY ending) AS items,
      count(DISTINCT ending) AS item_count FROM stems GROUP BY stem""",
)
def test_stem_ending_lists(spark, sf):
    return st.stem_ending_lists(corpora.event_lines(spark, sf))


@query(
    "pivot_followers",
    f"""WITH {q.EV} SELECT signs[3] AS pivot, signs[4] AS follower, count(*) AS count FROM ev
    WHERE len(signs) = 4 GROUP BY ALL""",
)
def pivot_followers(spark, sf):
    return st.pivot_followers(corpora.event_lines(spark, sf))


@query(
    "support_scores",
    f"WITH {q.EV}, {_STEMS} SELECT stem, {stem_support_sql()} AS support FROM stem_rows",
)
def support_scores(spark, sf):
    return st.stem_support(cut(corpora.event_lines(spark, sf)))


@query(
    "support_scores_pivot",
    f"""WITH {q.EV}, {tail_sql()} SELECT observed_total, observed_count, expected_mean_under_null,
      round(p_value_ge_observed, 6) AS p_value_ge_observed,
      {PIVOT_SUPPORT} AS support FROM tail""",
)
def support_scores_pivot(spark, sf):
    test = st.position_test(corpora.event_lines(spark, sf), TOKEN, LENGTH, POSITION)
    return st.pivot_support(test).withColumn("p_value_ge_observed", F.round("p_value_ge_observed", 6))


def metrics_sql(source: str) -> str:
    return f"""pc AS (SELECT length, position, token, count(*) AS n FROM (SELECT len(signs) AS length,
        generate_subscripts(signs, 1) AS position, unnest(signs) AS token FROM {source})
      GROUP BY ALL),
    bl AS (SELECT length, sum(n) AS block FROM pc WHERE position = 1 GROUP BY length),
    slot AS (SELECT length, position, block, -sum((n / block) * ln(n / block + 1e-15::DOUBLE)) AS h,
        count(*) AS kinds, max(n) AS top FROM pc JOIN bl USING (length) GROUP BY ALL),
    bg AS (SELECT g, count(*) AS n FROM (SELECT unnest(list_transform(
        generate_series(1, len(signs) - 1), lambda i: signs[i] || ' ' || signs[i + 1])) AS g
        FROM {source}) GROUP BY g),
    bt AS (SELECT sum(n) AS total, count(*) AS kinds FROM bg),
    bh AS (SELECT -sum((n / total) * ln(n / total + 1e-15::DOUBLE)) AS h, first(kinds) AS kinds
      FROM bg, bt),
    metrics AS (SELECT
      greatest(0, least(1, (SELECT sum(h / CASE WHEN kinds > 1 THEN ln(kinds) ELSE 1e-12::DOUBLE END
        * block) / sum(block) FROM slot))) AS positional_entropy_norm,
      (SELECT max(n) / sum(n) FROM (SELECT count(*) AS n FROM {source} GROUP BY signs[1]))
        AS first_token_concentration,
      (SELECT sum(top) / sum(block) FROM slot) AS template_dominance,
      greatest(0, least(1, 1 - (SELECT h / CASE WHEN kinds > 1 THEN ln(kinds) ELSE 1e-12::DOUBLE END
        FROM bh))) AS bigram_predictability),
    align AS (SELECT model, 100 * (1 - (abs(positional_entropy_norm - a)
        + abs(first_token_concentration - b) + abs(template_dominance - c)
        + abs(bigram_predictability - d)) / 4) AS alignment FROM metrics,
      (VALUES ('unigram', 0.78::DOUBLE, 0.25::DOUBLE, 0.35::DOUBLE, 0.40::DOUBLE),
        ('first_bigram', 0.56, 0.50, 0.50, 0.62), ('position', 0.38, 0.58, 0.82, 0.74))
        t(model, a, b, c, d))"""


@query(
    "structural_metrics",
    f"""WITH {q.EV}, {metrics_sql("ev")} SELECT round(positional_entropy_norm, 6)
      AS positional_entropy_norm, round(first_token_concentration, 6) AS first_token_concentration,
      round(template_dominance, 6) AS template_dominance,
      round(bigram_predictability, 6) AS bigram_predictability FROM metrics""",
)
def structural_metrics(spark, sf):
    return cv.rounded(st.structural_metrics(cut(corpora.event_lines(spark, sf))))


@query(
    "alignment_score",
    f"WITH {q.EV}, {metrics_sql('ev')} SELECT model, round(alignment, 6) AS alignment FROM align",
)
def alignment_score(spark, sf):
    lines = cut(corpora.event_lines(spark, sf))
    return cv.rounded(st.alignment(st.structural_metrics(lines)))


def _line_scores_sql(model: str) -> str:
    return f"""WITH {q.EV}, {q.MODEL_KINDS}, {q.cells("test", "ev", ["line_id"])},
      {q.transfer("sc", "test", "test", ["line_id"])}
    SELECT line_id, model, round(ll, 6) AS ll, lines::BIGINT AS lines, tokens::BIGINT AS tokens
    FROM sc JOIN sc_z USING (line_id) WHERE model = '{model}'"""


def _line_scores(model: str):
    def run(spark, sf):
        lines = cut(corpora.event_lines(spark, sf))
        kinds = md.needed([model])
        scored = md.transfer(
            md.cells(lines, kinds=kinds), md.cells(lines, ["line_id"], kinds), ["line_id"], [model]
        )
        return cv.rounded(scored)

    return run


for _key, _model in {
    "lm_unigram": "unigram",
    "lm_first_bigram": "first_bigram",
    "lm_bigram": "bigram",
    "lm_trigram": "trigram",
    "lm_position_by_length": "position",
}.items():
    query(_key, _line_scores_sql(_model))(_line_scores(_model))


def loo_sql(source: str, name: str = "loo") -> str:
    return f"""{name}_in AS (SELECT 'leave_one_artifact_out' AS split, artifact_id AS grp, signs
      FROM {source}), {q.cells(f"{name}_own", f"{name}_in", ["split", "grp"])},
    {q.leave_out(name, f"{name}_own", ["grp"])}"""


def pooled_sql(name: str) -> str:
    return f"""SELECT split, model, count(*) AS folds, sum(lines)::BIGINT AS test_lines,
      sum(tokens)::BIGINT AS test_tokens, sum(ll) / sum(tokens) AS mean_log_likelihood_per_token,
      exp(-(sum(ll) / sum(tokens))) AS perplexity FROM {name} GROUP BY split, model"""


def kfold_sql(source: str) -> str:
    return f"""dealt AS (SELECT signs, 'kfold' AS split, ((row_number() OVER (
      ORDER BY md5(line_id || '|{cv.SEED}'), line_id) - 1) % 5)::VARCHAR AS grp FROM {source}),
  {q.cells("kf_own", "dealt", ["split", "grp"])}, {q.leave_out("kf", "kf_own", ["grp"])}"""

_SIX = """split, model, folds, test_lines, test_tokens,
  round(mean_log_likelihood_per_token, 6) AS mean_log_likelihood_per_token,
  round(perplexity, 6) AS perplexity"""


@query(
    "cv_leave_one_group_out",
    f"WITH {q.EV}, {q.MODEL_KINDS}, {loo_sql('ev')} SELECT {_SIX} FROM ({pooled_sql('loo')})",
)
def cv_leave_one_group_out(spark, sf):
    lines = corpora.event_lines(spark, sf)
    return cv.rounded(cv.leave_one_group_out(lines, models=tuple(md.MODELS)))


@query(
    "cv_kfold",
    f"WITH {q.EV}, {q.MODEL_KINDS}, {kfold_sql('ev')} SELECT {_SIX} FROM ({pooled_sql('kf')})",
)
def cv_kfold(spark, sf):
    return cv.rounded(cv.kfold(corpora.event_lines(spark, sf), tuple(md.MODELS)))


HOLDOUT = f"""{q.ATTRS}, ho_in AS (SELECT signs, unnest(['artifact_held_out', 'site_held_out',
      'region_held_out', 'object_class_held_out', 'formula_class_held_out',
      'inscription_length_held_out']) AS split, unnest([artifact_id, site, region, object_class,
      formula_class, length_bucket]) AS grp FROM attrs),
  {q.MODEL_KINDS}, {q.cells("ho_own", "ho_in", ["split", "grp"])},
  {q.leave_out("ho", "ho_own", ["grp"])},
  holdout AS (SELECT split, model, count(*) AS folds, sum(lines)::BIGINT AS test_lines,
      sum(tokens)::BIGINT AS test_tokens, round(avg(ll / tokens), 6)
      AS mean_log_likelihood_per_token, round(avg(exp(-(ll / tokens))), 6) AS perplexity
    FROM ho WHERE model <> 'first_bigram'
      AND lines >= CASE split WHEN 'artifact_held_out' THEN 4 ELSE 10 END
    GROUP BY split, model)"""


def holdout(spark, sf):
    return cv.attribute_holdout(cl.attributes(cut(corpora.coded_lines(spark, sf))))


@query("cv_attribute_holdout", f"WITH {HOLDOUT} SELECT * FROM holdout")
def cv_attribute_holdout(spark, sf):
    return holdout(spark, sf)


AGAINST = """SELECT *, round(gain, 6) AS ll_improvement_over_unigram,
    (gain > 0.01)::INT AS beats_unigram FROM (SELECT *, mean_log_likelihood_per_token
      - max(mean_log_likelihood_per_token) FILTER (model = 'unigram')
        OVER (PARTITION BY split) AS gain FROM holdout)"""


@query("cv_vs_baseline", f"WITH {HOLDOUT} SELECT * EXCLUDE (gain) FROM ({AGAINST})")
def cv_vs_baseline(spark, sf):
    return cv.against_baseline(holdout(spark, sf))


def bakeoff_sql(source: str) -> str:
    return f"""{loo_sql(source)}, {kfold_sql(source)}, {metrics_sql(source)},
  sch AS ({pooled_sql("loo")} UNION ALL {pooled_sql("kf")}),
  rk AS (SELECT split AS cv_scheme, sch.* EXCLUDE (split), alignment, CASE WHEN
      max(mean_log_likelihood_per_token) OVER w > min(mean_log_likelihood_per_token) OVER w
      THEN 100 * (mean_log_likelihood_per_token - min(mean_log_likelihood_per_token) OVER w)
        / (max(mean_log_likelihood_per_token) OVER w - min(mean_log_likelihood_per_token) OVER w)
      ELSE 50 END AS cv_rank_score FROM sch JOIN align USING (model)
    WINDOW w AS (PARTITION BY split)),
  ov AS (SELECT *, 0.65 * cv_rank_score + 0.35 * alignment AS overall_goodness_score FROM rk),
  comb AS (SELECT model, 'combined' AS cv_scheme, sum(folds)::BIGINT AS folds,
      sum(test_lines)::BIGINT AS test_lines, sum(test_tokens)::BIGINT AS test_tokens,
      avg(mean_log_likelihood_per_token) AS mean_log_likelihood_per_token,
      avg(perplexity) AS perplexity, avg(alignment) AS alignment,
      avg(cv_rank_score) AS cv_rank_score, avg(overall_goodness_score) AS overall_goodness_score
    FROM ov GROUP BY model),
  comb2 AS (SELECT *, (row_number() OVER (ORDER BY overall_goodness_score DESC, model) = 1)::INT
    AS is_best_model FROM comb)"""

_BAKE_COLS = """model, cv_scheme, folds, test_lines, test_tokens,
  round(mean_log_likelihood_per_token, 6) AS mean_log_likelihood_per_token,
  round(perplexity, 6) AS perplexity, round(alignment, 6) AS alignment,
  round(cv_rank_score, 6) AS cv_rank_score,
  round(overall_goodness_score, 6) AS overall_goodness_score"""


def baked(spark, sf):
    lines = cut(corpora.event_lines(spark, sf))
    return cv.bakeoff(lines, st.alignment(st.structural_metrics(lines)))


@query("model_bakeoff", f"WITH {q.EV}, {q.MODEL_KINDS}, {bakeoff_sql('ev')} SELECT {_BAKE_COLS} FROM ov")
def model_bakeoff(spark, sf):
    rows = baked(spark, sf).where("cv_scheme <> 'combined'").drop("is_best_model")
    return cv.rounded(rows)


@query(
    "model_combined_winner", f"WITH {q.EV}, {q.MODEL_KINDS}, {bakeoff_sql('ev')} SELECT {_BAKE_COLS}, is_best_model FROM comb2"
)
def model_combined_winner(spark, sf):
    return cv.rounded(baked(spark, sf).where("cv_scheme = 'combined'"))
