"""Classification, inventories, volumes, scorecards and run comparison."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from linegrain.checks import corpus_sql as q
from linegrain.operators import classify as cl
from linegrain.operators import cv
from linegrain.operators import normalize as nz
from linegrain.operators import perturb as pt
from linegrain.operators import profiles as pf
from linegrain.operators import runs as rn
from linegrain.operators import scorecard as sc
from linegrain.operators import stats as st
from linegrain.operators import templates as tp
from linegrain.operators import volumes as vo
from linegrain.plans import perturb_queries as pq
from linegrain.plans.model_queries import (
    AGAINST, bakeoff_sql, HOLDOUT, holdout, LENGTH, PIVOT_SUPPORT, pooled_sql, POSITION, stem_support_sql, stems_sql, tail_sql,
)
from linegrain.plans.profile_queries import EVENT_SHARE, templates_sql
from linegrain.plans.registry import query
from linegrain.plans.source_queries import scratch_root
from linegrain.session import cut
from linegrain.sources import corpora, sinks


def _attributed(spark, sf):
    return cl.attributes(corpora.coded_lines(spark, sf))


@query(
    "cls_site_region",
    f"WITH {q.ATTRS} SELECT DISTINCT artifact_id, site, region FROM attrs",
)
def cls_site_region(spark, sf):
    return _attributed(spark, sf).select("artifact_id", "site", "region").distinct()


@query("cls_object_class", f"WITH {q.ATTRS} SELECT DISTINCT artifact_id, object_class FROM attrs")
def cls_object_class(spark, sf):
    return _attributed(spark, sf).select("artifact_id", "object_class").distinct()


@query(
    "cls_formula",
    f"""WITH {q.ATTRS} SELECT array_to_string(signs, ' ') AS sequence, formula_class,
      count(*) AS lines FROM attrs GROUP BY ALL""",
)
def cls_formula(spark, sf):
    sequence = F.array_join("signs", " ").alias("sequence")
    return _attributed(spark, sf).groupBy(sequence, "formula_class").agg(
        F.count(F.lit(1)).alias("lines")
    )


@query(
    "cls_purpose",
    f"WITH {q.ATTRS} SELECT line_id, {q.PURPOSE} AS purpose FROM attrs",
)
def cls_purpose(spark, sf):
    kind = cl.purpose(F.col("object_class"), F.col("formula_class"))
    return _attributed(spark, sf).select("line_id", kind.alias("purpose"))


@query(
    "cls_length_bucket",
    f"WITH {q.ATTRS} SELECT length_bucket, count(*) AS lines FROM attrs GROUP BY length_bucket",
)
def cls_length_bucket(spark, sf):
    return _attributed(spark, sf).groupBy("length_bucket").agg(F.count(F.lit(1)).alias("lines"))


METADATA = f"""{q.ATTRS}, cf AS (SELECT artifact_id, formula_class, count(*) AS n,
      min(line_id) AS first_line FROM attrs GROUP BY ALL),
  mo AS (SELECT artifact_id, first(formula_class ORDER BY n DESC, first_line) AS formula_class
    FROM cf GROUP BY artifact_id),
  su AS (SELECT artifact_id, string_agg(t, ' ' ORDER BY t) AS used FROM (SELECT DISTINCT
      artifact_id, unnest(signs) AS t FROM attrs) GROUP BY artifact_id),
  pr AS (SELECT artifact_id, string_agg(provenance, '; ' ORDER BY provenance) AS tags FROM (
      SELECT DISTINCT artifact_id, provenance FROM attrs) GROUP BY artifact_id),
  ro AS (SELECT artifact_id, first(site) AS site, first(region) AS region,
      first(object_class) AS object_class, sum(len(signs))::BIGINT AS sign_count,
      count(*) AS line_count, bool_or(list_has_any(signs, ['GRA','OLE','OLIV','VINA','VIN','FIC',
        'OVIS','CAP'])) AS ideo, bool_or(quantity IS NOT NULL) AS nume,
      sum(len(list_filter(signs, lambda t: t IN ('[?]', '?')))) AS unknown FROM attrs
    GROUP BY artifact_id),
  m0 AS (SELECT *, {q.PURPOSE} AS kind FROM ro JOIN mo USING (artifact_id)
    JOIN su USING (artifact_id) JOIN pr USING (artifact_id)),
  meta AS (SELECT artifact_id AS inscription_id, tags AS provenance_source_url,
      site AS site_find_place, region, object_class AS object_type, kind AS classification,
      formula_class, sign_count AS inscription_length, line_count, sign_count,
      sign_count AS word_count, used AS sign_inventory_used,
      (object_class = 'inscription_or_vessel' AND formula_class <> 'commodity_accounting')::INT
        ::VARCHAR AS libation_formula_candidate,
      (kind = 'administrative')::INT::VARCHAR AS accounting_candidate,
      ideo::INT::VARCHAR AS ideogram_presence, nume::INT::VARCHAR AS numeral_presence,
      round(unknown / greatest(1, sign_count), 4) AS damage_unreadability_level FROM m0)"""


def _metadata(spark, sf):
    return cl.artifact_metadata(corpora.coded_lines(spark, sf))


@query("artifact_metadata", f"WITH {METADATA} SELECT * FROM meta")
def artifact_metadata(spark, sf):
    return _metadata(spark, sf)


@query(
    "metadata_coverage",
    f"""WITH {METADATA} SELECT CASE WHEN region IS NOT NULL THEN 'region'
        WHEN object_type IS NOT NULL THEN 'object_type'
        WHEN formula_class IS NOT NULL THEN 'formula_class' ELSE 'all' END AS dimension,
      coalesce(region, object_type, formula_class, '') AS value, count(*) AS inscriptions,
      count(DISTINCT site_find_place) AS sites FROM meta
    GROUP BY GROUPING SETS ((region), (object_type), (formula_class), ())""",
)
def metadata_coverage(spark, sf):
    return cl.metadata_coverage(_metadata(spark, sf))


def _confidence_sql() -> str:
    values = " ".join(f"WHEN '{n}' THEN {round(c * 100, 1)}" for n, (c, _) in cl.FORMULA_CONFIDENCE.items())
    reasons = " ".join(f"WHEN '{n}' THEN '; {r}'" for n, (_, r) in cl.FORMULA_CONFIDENCE.items())
    return f"""(CASE formula_class {values} ELSE 22.0 END)::DOUBLE AS confidence_percent,
      '{cl.BASIS}' || (CASE formula_class {reasons} ELSE '' END) AS classification_basis"""


@query(
    "formula_inventory",
    f"""WITH {METADATA}, k AS (SELECT formula_class, object_type, count(*) AS n FROM meta GROUP BY ALL),
      u AS (SELECT formula_class, first(object_type ORDER BY n DESC, object_type)
        AS dominant_object_type FROM k GROUP BY formula_class),
      s AS (SELECT formula_class, array_to_string(list_sort(list(DISTINCT site_find_place)),
        '; ') AS sites FROM meta GROUP BY formula_class)
    SELECT formula_class, count(*) AS supporting_inscriptions, sites, dominant_object_type,
      count(*) FILTER (accounting_candidate = '1') AS accounting_candidates,
      count(*) FILTER (libation_formula_candidate = '1') AS libation_candidates,
      {_confidence_sql()}
    FROM meta JOIN u USING (formula_class) JOIN s USING (formula_class) GROUP BY ALL""",
)
def formula_inventory(spark, sf):
    return cl.formula_inventory(cut(_metadata(spark, sf)))


def _count_sql(*parts: str) -> str:
    return " + ".join(
        f"((length(txt) - length(replace(txt, '{p}', ''))) / {len(p)})" for p in parts
    )


@query(
    "anchor_support",
    f"""WITH {q.CODED}, al AS (SELECT string_agg(array_to_string(signs, ' '), ' '
        ORDER BY artifact_id, line_id) AS txt FROM coded)
    SELECT 'commodity_logograms' AS anchor_id,
      ({_count_sql("GRA", "OLE", "VINA", "FIC", "OLIV")})::BIGINT AS observed_support_count,
      62.0::DOUBLE AS confidence_percent, 'moderate' AS tier FROM al
    UNION ALL SELECT 'ku_ro_total_formula', ({_count_sql("KU RO")})::BIGINT, 58.0, 'moderate' FROM al
    UNION ALL SELECT 'ab22_positional_pivot', ({_count_sql("AB22")})::BIGINT, 54.0, 'low' FROM al""",
)
def anchor_support(spark, sf):
    return cl.anchor_support(cut(corpora.coded_lines(spark, sf)), ["artifact_id", "line_id"])


# ---- volumes ----------------------------------------------------------------

# The dictionary of coded event lines: the first token names the commodity, the
# length of the sequence the unit.
DICTIONARY = """dict AS (SELECT DISTINCT array_to_string(signs, ' ') AS sequence,
    CASE signs[1] WHEN 'GRA' THEN 'grain' WHEN 'KU' THEN 'oil' WHEN 'RO' THEN 'wine'
      WHEN 'AB22' THEN 'prestige?' END AS commodity,
    CASE least(len(signs), 7) WHEN 1 THEN 'measure tag' WHEN 2 THEN 'small jar'
      WHEN 3 THEN 'large measure' WHEN 4 THEN 'amphoraA' WHEN 5 THEN 'amphoraB'
      WHEN 6 THEN 'big jar' ELSE 'unit?' END AS unit,
    CASE WHEN len(signs) <= 3 THEN 'high' ELSE 'medium' END AS confidence
  FROM coded WHERE signs[1] <> 'A12')"""
SUBSTITUTED = f"""{q.CODED}, {DICTIONARY}, subs AS (SELECT line_id, artifact_id, quantity,
    array_to_string(signs, ' ') AS sequence, commodity, unit, confidence FROM coded
  LEFT JOIN dict ON dict.sequence = array_to_string(signs, ' ')),
  vol AS (SELECT *, quantity * CASE unit WHEN 'big jar' THEN 50 WHEN 'amphoraA' THEN 30
      WHEN 'amphoraB' THEN 30 WHEN 'large measure' THEN 10 WHEN 'small jar' THEN 5
      WHEN 'measure tag' THEN 1 ELSE 0 END AS litres FROM subs
    WHERE unit IS NOT NULL AND quantity IS NOT NULL)"""


def _substituted(spark, sf):
    lines = corpora.coded_lines(spark, sf)
    first, n = F.get("signs", F.lit(0)), F.size("signs")
    commodity = (
        F.when(first == "GRA", "grain").when(first == "KU", "oil").when(first == "RO", "wine")
        .when(first == "AB22", "prestige?")
    )
    units = ["measure tag", "small jar", "large measure", "amphoraA", "amphoraB", "big jar", "unit?"]
    dictionary = (
        lines.where(first != "A12")
        .select(
            F.array_join("signs", " ").alias("sequence"),
            commodity.alias("commodity"),
            F.get(F.array(*map(F.lit, units)), F.least(n, F.lit(7)) - 1).alias("unit"),
            F.when(n <= 3, "high").otherwise("medium").alias("confidence"),
        )
        .distinct()
    )
    return vo.substitute(lines.select("line_id", "artifact_id", "quantity", "signs"), dictionary)


@query("dict_substitution", f"WITH {SUBSTITUTED} SELECT * FROM subs")
def dict_substitution(spark, sf):
    return _substituted(spark, sf).drop("signs")


@query("unit_volumes", f"WITH {SUBSTITUTED} SELECT * FROM vol")
def unit_volumes(spark, sf):
    return vo.volumes(_substituted(spark, sf)).drop("signs")


@query(
    "volume_totals_share",
    f"""WITH {SUBSTITUTED} SELECT commodity, sum(litres)::BIGINT AS litres,
      round(100.0::DOUBLE * sum(litres) / sum(sum(litres)) OVER (), 6) AS percent
    FROM vol GROUP BY commodity""",
)
def volume_totals_share(spark, sf):
    return vo.totals(vo.volumes(_substituted(spark, sf)))


_RATIOS = f"""{SUBSTITUTED}, wide AS (SELECT artifact_id,
      sum(litres) FILTER (commodity = 'grain') AS g, sum(litres) FILTER (commodity = 'oil') AS o,
      sum(litres) FILTER (commodity = 'wine') AS w FROM vol
    WHERE commodity IN ('grain', 'oil', 'wine') GROUP BY artifact_id),
  w0 AS (SELECT artifact_id, coalesce(g, 0) AS g, coalesce(o, 0) AS o, coalesce(w, 0) AS w FROM wide)"""


@query(
    "group_ratios",
    f"""WITH {_RATIOS} SELECT artifact_id, round(g / (g + o + w), 6) AS grain,
      round(o / (g + o + w), 6) AS oil, round(w / (g + o + w), 6) AS wine FROM w0
    WHERE g + o + w > 0""",
)
def group_ratios(spark, sf):
    return vo.group_ratios(vo.volumes(_substituted(spark, sf)))


def _lloyd_sql(steps: int = 40) -> str:
    """``lloyd``: the centres after so many steps, which the rows here need far fewer of to settle."""
    names = [f"c{i}_{c}" for i in range(len(vo.CENTRES)) for c in vo.STAPLES]
    start = ", ".join(f"{x!r}::DOUBLE AS {n}" for n, x in zip(names, [x for c in vo.CENTRES for x in c], strict=True))
    means = ", ".join(
        f"coalesce(round(avg({c}) FILTER (i = {i}), 9), any_value(c{i}_{c}))" for i in range(len(vo.CENTRES)) for c in vo.STAPLES
    )
    return f"""rt AS (SELECT artifact_id, round(g / (g + o + w), 6) AS grain,
      round(o / (g + o + w), 6) AS oil, round(w / (g + o + w), 6) AS wine FROM w0 WHERE g + o + w > 0),
  lloyd AS (SELECT 0 AS step, {start} UNION ALL
    SELECT step + 1, {means} FROM (SELECT l.*, rt.*, {_near("l")} AS i FROM lloyd l, rt) WHERE step < {steps} GROUP BY step)"""


def _near(at: str) -> str:
    far = [
        "round(" + " + ".join(f"(rt.{c} - {at}.c{i}_{c}) * (rt.{c} - {at}.c{i}_{c})" for c in vo.STAPLES) + ", 12)"
        for i in range(len(vo.CENTRES))
    ]
    return f"CASE WHEN {far[0]} <= {far[1]} THEN 0 ELSE 1 END"


@query(
    "ratio_clusters",
    f"""WITH RECURSIVE {_RATIOS}, {_lloyd_sql()} SELECT rt.artifact_id, grain, oil, wine, {_near("l")} AS cluster
    FROM rt, (SELECT * FROM lloyd ORDER BY step DESC LIMIT 1) l""",
)
def ratio_clusters(spark, sf):
    return vo.ratio_clusters(vo.group_ratios(vo.volumes(_substituted(spark, sf))))


# ---- scorecards -------------------------------------------------------------

WINNER = "(SELECT model FROM comb2 WHERE is_best_model = 1)"
PIVOT = "AB22"
SCORE = f"""{pq.SUITE_TABLES}, {tail_sql("mode_strict", PIVOT)}, {stems_sql("mode_strict")}, {bakeoff_sql("mode_strict")}, {pq.suite_sql(WINNER)},
  {templates_sql("mode_strict", EVENT_SHARE)},
  inp AS (SELECT (SELECT count(*) FROM mode_strict) AS lines,
      (SELECT count(DISTINCT artifact_id) FROM mode_strict) AS artifacts,
      (SELECT count(*) FROM coded) AS sources,
      (SELECT count(*) FROM (SELECT unnest(signs) AS t FROM coded) WHERE t = 'RO') AS flag_count,
      (SELECT sum(len(signs)) FROM coded) AS event_count,
      (SELECT round(sum(coverage * entries_in_length_group) / (SELECT count(*) FROM mode_strict), 6)
        FROM tmpl) AS coverage,
      (SELECT mean_log_likelihood_per_token FROM comb2 WHERE is_best_model = 1) AS winner_ll,
      (SELECT mean_log_likelihood_per_token FROM comb2 WHERE model = 'unigram') AS unigram_ll,
      (SELECT alignment FROM comb2 WHERE model = 'position') AS position_alignment,
      (SELECT perturbed_log_likelihood FROM suite WHERE test_name = 'normalization_mode_identity')
        AS identity_ll,
      (SELECT perturbed_log_likelihood FROM suite WHERE test_name = 'normalization_mode_permissive')
        AS permissive_ll,
      (SELECT avg(abs(delta_log_likelihood)) FROM suite WHERE test_name IN
        ('randomized_sign_relabel_global', 'normalization_mode_identity',
         'normalization_mode_permissive')) AS benign,
      (SELECT avg(abs(delta_log_likelihood)) FROM suite WHERE test_name IN
        ('shuffled_sequence_control', 'randomized_sign_relabel_per_line')) AS destructive,
      (SELECT min(delta_log_likelihood) FROM suite WHERE test_name IN
        ('cross_corpus_segmentation', 'remove_20pct_external_random', 'shuffled_sequence_control',
         'randomized_sign_relabel_per_line')) AS guard_delta),
  comp AS (SELECT *, 0.55::DOUBLE * least(1, lines / 150) + 0.25::DOUBLE * least(1, artifacts / 20)
        + 0.2::DOUBLE * least(1, sources / 200) AS corpus_adequacy_score,
      greatest(0, 1 - least(1, (abs(identity_ll - winner_ll) + abs(permissive_ll - winner_ll)) / 2))
        * (1 - least(0.5::DOUBLE, flag_count / greatest(1, event_count)))
        AS normalization_stability_score,
      0.6::DOUBLE * position_alignment / 100 + 0.4::DOUBLE * coverage
        AS template_predictability_score,
      1 / (1 + exp(-6 * (winner_ll - unigram_ll))) AS out_of_sample_performance_score,
      0.5::DOUBLE * exp(-benign) + 0.5::DOUBLE * least(1, destructive / 0.8::DOUBLE)
        AS adversarial_robustness_score FROM inp),
  sc0 AS (SELECT *, 100 * (0.25::DOUBLE * corpus_adequacy_score
      + 0.2::DOUBLE * normalization_stability_score + 0.2::DOUBLE * template_predictability_score
      + 0.2::DOUBLE * out_of_sample_performance_score
      + 0.15::DOUBLE * adversarial_robustness_score) AS raw_score,
      least(corpus_adequacy_score, normalization_stability_score, template_predictability_score,
        out_of_sample_performance_score, adversarial_robustness_score) AS lo FROM comp),
  sc1 AS (SELECT *, lines >= 80 AND artifacts >= 12 AND lo >= 0.7
      AND out_of_sample_performance_score >= 0.7 AS strict_gate FROM sc0),
  sc2 AS (SELECT *, CASE WHEN strict_gate THEN raw_score ELSE least(raw_score, 84.99::DOUBLE) END
      AS gated FROM sc1),
  sup AS (SELECT greatest((SELECT {PIVOT_SUPPORT} FROM tail), (SELECT max({stem_support_sql("mode_strict")}) FROM stem_rows),
      0) AS structural, {dict((k, v) for _, k, v in sc.CLAIMS)["semantic mapping"]}::DOUBLE AS semantic),
  sc2s AS (SELECT *, semantic > structural AS semantic_stronger FROM sc2, sup),
  sc3 AS (SELECT *, gated >= 85 OR semantic_stronger AS guard_triggered,
      (gated >= 85 OR semantic_stronger) AND coalesce(guard_delta <= -0.45, false) AS guard_collapse FROM sc2s),
  scored AS (SELECT *, CASE WHEN guard_collapse THEN least(gated, 84.99::DOUBLE) ELSE gated END
      AS final_score FROM sc3)"""


def scored_inputs(spark, sf):
    """The scored one-row table of the coded corpus, from the tables that it depends on."""
    strict = pq.mode_lines(spark, sf, "strict")
    metrics = cut(st.alignment(st.structural_metrics(strict)))
    combined = cut(cv.bakeoff(strict, metrics).where("cv_scheme = 'combined'"))
    winner = combined.where("is_best_model = 1").first()["model"]
    modes = {m: pq.mode_lines(spark, sf, m) for m in ("identity", "permissive")}
    suite = cut(pt.suite(strict, winner, modes))
    log = cut(nz.mapping_log(pq.coded_observations(spark, sf), pq.event_variants(spark)))
    coverage = tp.weighted_coverage(strict, tp.templates(strict, EVENT_SHARE))
    pivot = st.pivot_support(st.position_test(strict, PIVOT, LENGTH, POSITION))
    supported = sc.hypotheses(pivot, st.stem_support(strict))
    return cut(sc.scored(sc.inputs(strict, nz.flags(log), log, coverage, combined, suite, supported)))


_COMPONENTS = " UNION ALL ".join(
    f"SELECT '{c}' AS component, round({c}, 6) AS score, {w}::DOUBLE AS weight, "
    f"round({c} * {w}::DOUBLE * 100, 6) AS contribution FROM scored"
    for c, w in sc.WEIGHTS.items()
)


@query("score_components", f"WITH {SCORE} {_COMPONENTS}")
def score_components(spark, sf):
    return sc.components(scored_inputs(spark, sf))


@query(
    "score_gate",
    f"""WITH {SCORE} SELECT lines, artifacts, round(raw_score, 6) AS raw_score,
      round(final_score, 6) AS final_score, strict_gate, final_score >= 85 AS threshold_85_reached,
      semantic_stronger, guard_triggered, guard_collapse,
      round(CASE WHEN guard_triggered THEN guard_delta END, 6) AS guard_min_delta,
      array_to_string(list_filter([CASE WHEN lines < 80 THEN 'corpus_size' END,
        CASE WHEN artifacts < 12 THEN 'artifact_diversity' END,
        CASE WHEN lo < 0.7 THEN 'component_convergence' END,
        CASE WHEN guard_collapse THEN 'stress_guard_collapse' END], lambda x: x IS NOT NULL), ',')
        AS limiting_factors FROM scored""",
)
def score_gate(spark, sf):
    return sc.gate(scored_inputs(spark, sf))


def _sweep_sql() -> str:
    names = list(sc.WEIGHTS)
    rows = [("base", "base_weights", list(sc.WEIGHTS.values()))]
    for name in names:
        for sign, label in ((-1, "minus"), (1, "plus")):
            w = {**sc.WEIGHTS, name: max(sc.FLOOR, sc.WEIGHTS[name] + sign * sc.SHIFT)}
            rows.append((f"oat_{name}_{label}", "one_at_a_time", list(w.values())))
    fixed = ", ".join(
        f"('{i}', '{t}', {', '.join(f'{float(x)!r}::DOUBLE' for x in w)})" for i, t, w in rows
    )
    draws = ", ".join(
        pq.hash_sql("i::VARCHAR", f"'{j}'", "'303'") + f" / {float(1 << 48)!r}::DOUBLE + 0.01::DOUBLE"
        for j in range(5)
    )
    shares = ", ".join(f"w{j} / (w0 + w1 + w2 + w3 + w4) AS x{j}" for j in range(5))
    raw = " + ".join(f"{n} * x{j}" for j, n in enumerate(names))
    shown = ", ".join(f"round(x{j}, 6) AS w_{n}" for j, n in enumerate(names))
    return f"""ws(scenario_id, scenario_type, w0, w1, w2, w3, w4) AS (SELECT * FROM (VALUES {fixed})
      UNION ALL SELECT printf('rand_%03d', i), 'random_weights', {draws}
        FROM (SELECT unnest(generate_series(1, 400)) AS i)),
    wn AS (SELECT scenario_id, scenario_type, {shares} FROM ws)
    SELECT scenario_id, scenario_type, {shown}, round(100 * ({raw}), 6) AS raw_score,
      round(CASE WHEN strict_gate THEN 100 * ({raw}) ELSE least(100 * ({raw}), 84.99::DOUBLE) END, 6)
        AS capped_score FROM scored, wn"""


@query("score_weight_sweep", f"WITH {SCORE}, {_sweep_sql()}")
def score_weight_sweep(spark, sf):
    return sc.weight_sweep(scored_inputs(spark, sf))


def _bands_sql() -> str:
    """The tiers, from the tables of four other queries, each in a scope of its own."""
    tiers = {
        "corpus_adequacy_confidence": "corpus", "normalization_confidence": "norm", "structural_script_confidence": "structure",
        "template_predictability_confidence": "template", "out_of_sample_prediction_confidence": "oos",
        "overall_structural_confidence": "overall",
    }
    rows = " UNION ALL ".join(f"SELECT '{n}' AS tier, greatest(0.0::DOUBLE, least(99.0::DOUBLE, 100 * {c})) AS score FROM t3" for n, c in tiers.items())
    return f"""WITH s AS (WITH {SCORE} SELECT normalization_stability_score AS stability,
      template_predictability_score AS template, adversarial_robustness_score AS robustness FROM scored),
  o AS (WITH {pq.in_sample_sql(q.CODED, "coded")} SELECT min(delta) AS order_drop FROM insample
    WHERE test_name = 'within_line_shuffle' AND model <> 'unigram'),
  g AS (WITH {HOLDOUT} SELECT avg(round(gain, 6)) AS gain FROM ({AGAINST}) WHERE model <> 'unigram'),
  b AS (WITH {q.ATTRS} SELECT count(*) AS lines, count(DISTINCT artifact_id) AS artifacts, count(DISTINCT site) AS sites,
      count(*) FILTER (coalesce(provenance, '') <> '') / greatest(1, count(*)) AS provenance_share,
      sum(len(list_filter(signs, lambda t: contains(t, '[?]')))) / greatest(1, sum(len(signs))) AS unknown_rate FROM attrs),
  t1 AS (SELECT *, greatest(0, least(1, 0.5::DOUBLE + coalesce(gain, 0) / 1.2::DOUBLE)) AS oos,
      greatest(0, least(1, abs(coalesce(order_drop, 0)) / 0.65::DOUBLE)) AS ordered,
      0.3::DOUBLE * least(1, lines / 2500) + 0.25::DOUBLE * least(1, artifacts / 600) + 0.2::DOUBLE * provenance_share
        + 0.15::DOUBLE * least(1, sites / 20) + 0.1::DOUBLE * (1 - least(0.5::DOUBLE, unknown_rate)) AS corpus,
      greatest(0, least(1, stability - unknown_rate)) AS norm FROM s, o, g, b),
  t2 AS (SELECT *, 0.35::DOUBLE * oos + 0.3::DOUBLE * ordered + 0.2::DOUBLE * robustness + 0.15::DOUBLE * template AS structure FROM t1),
  t3 AS (SELECT *, 0.25::DOUBLE * corpus + 0.2::DOUBLE * norm + 0.25::DOUBLE * structure + 0.15::DOUBLE * template
      + 0.15::DOUBLE * oos AS overall FROM t2)
  SELECT tier, round(score, 2) AS confidence_percent, CASE WHEN score >= 85 THEN 'high' WHEN score >= 70 THEN 'medium-high'
    WHEN score >= 50 THEN 'medium' WHEN score >= 25 THEN 'low' ELSE 'very low' END AS label FROM ({rows})"""


@query("score_bands", _bands_sql())
def score_bands(spark, sf):
    lines = cut(cl.attributes(corpora.coded_lines(spark, sf)))
    held = cv.against_baseline(cv.attribute_holdout(lines))
    return sc.tiers(sc.tier_inputs(lines, held, pt.in_sample_suite(lines), scored_inputs(spark, sf)))


# ---- runs -------------------------------------------------------------------

# Every day of events is one run; signups count as imported rows.
RUNS = """rl AS (SELECT strftime(ts, '%Y-%m-%d') AS run_id, user_id,
    list(upper(event_type) ORDER BY ts, event_id) AS signs, count(*) AS n,
    count(*) FILTER (event_type = 'signup') AS ext FROM events GROUP BY ALL),
  runs AS (SELECT run_id, sum(n)::BIGINT AS observations, count(*) AS canonical_entries,
    count(DISTINCT user_id) AS artifact_count, sum(ext)::BIGINT AS external_rows_loaded FROM rl
    GROUP BY run_id),
  cur AS (SELECT * FROM runs ORDER BY run_id DESC LIMIT 1),
  base AS (SELECT r.run_id AS baseline_run, CASE WHEN c.external_rows_loaded > 0
      AND r.external_rows_loaded = 0 THEN 3 WHEN c.external_rows_loaded > 0
      AND r.external_rows_loaded < floor(c.external_rows_loaded * 0.5) THEN 2 ELSE 1 END AS rule
    FROM runs r, cur c WHERE r.run_id < c.run_id ORDER BY rule DESC, baseline_run DESC LIMIT 1)"""


def _run_lines(spark, sf):
    lines = corpora.event_lines(spark, sf)
    return lines.withColumn("run_id", F.split("line_id", r"\|")[1])


def _runs(spark, sf):
    signups = F.size(F.filter("signs", lambda t: t == "SIGNUP"))
    return _run_lines(spark, sf).groupBy("run_id").agg(
        F.sum(F.size("signs")).alias("observations"),
        F.count(F.lit(1)).alias("canonical_entries"),
        F.count_distinct("artifact_id").alias("artifact_count"),
        F.sum(signups).alias("external_rows_loaded"),
    )


def _current_and_baseline(runs):
    current = runs.agg(F.max("run_id")).first()[0]
    return current, rn.pick_baseline(runs, current).first()["baseline_run"]


@query("run_pick_baseline", f"WITH {RUNS} SELECT baseline_run, rule::INT AS rule FROM base")
def run_pick_baseline(spark, sf):
    runs = cut(_runs(spark, sf))
    return rn.pick_baseline(runs, runs.agg(F.max("run_id")).first()[0])


_COVERED = """(SELECT round(coalesce(sum(coverage * entries_in_length_group), 0) / greatest(1, (SELECT count(*) FROM {src})), 6)
      FROM tmpl{tag})"""
_BASE_COVERAGE, _NOW_COVERAGE = _COVERED.format(src="rn_base", tag="_b"), _COVERED.format(src="rn_now", tag="_c")
_MEASURED = ", ".join(f"{c}::DOUBLE AS {c}" for c in ("observations", "canonical_entries", "artifact_count", "external_rows_loaded"))


@query(
    "run_delta_metrics",
    f"""WITH {RUNS}, {q.MODEL_KINDS},
    rn_base AS (SELECT * FROM rl WHERE run_id = (SELECT baseline_run FROM base)),
    rn_now AS (SELECT * FROM rl WHERE run_id = (SELECT run_id FROM cur)),
    rn_in AS (SELECT run_id AS split, 'U' || user_id AS grp, signs FROM rn_base UNION ALL SELECT run_id, 'U' || user_id, signs FROM rn_now),
    {q.cells("rn_own", "rn_in", ["split", "grp"])}, {q.leave_out("rn", "rn_own", ["grp"])},
    best AS (SELECT split AS run_id, first(model ORDER BY round(mean_log_likelihood_per_token, 9) DESC, model) AS label,
        max(round(mean_log_likelihood_per_token, 9)) AS v
      FROM ({pooled_sql("rn")}) WHERE model IN ('unigram', 'first_bigram', 'position') GROUP BY split),
    {templates_sql("rn_base", EVENT_SHARE, "_b")}, {templates_sql("rn_now", EVENT_SHARE, "_c")},
    m AS (SELECT run_id, metric, v, NULL::VARCHAR AS label FROM (UNPIVOT (SELECT run_id, {_MEASURED} FROM runs)
        ON observations, canonical_entries, artifact_count, external_rows_loaded INTO NAME metric VALUE v)
      UNION ALL SELECT baseline_run, 'coverage', {_BASE_COVERAGE}, NULL FROM base
      UNION ALL SELECT run_id, 'coverage', {_NOW_COVERAGE}, NULL FROM cur
      UNION ALL SELECT run_id, 'best_model', v, label FROM best)
    SELECT b.metric, round(b.v, 6) AS before, round(c.v, 6) AS after, round(c.v - b.v, 6) AS delta,
      b.label AS before_label, c.label AS after_label FROM m b
    JOIN m c ON b.metric = c.metric AND b.run_id = (SELECT baseline_run FROM base)
      AND c.run_id = (SELECT run_id FROM cur)""",
)
def run_delta_metrics(spark, sf):
    """Both runs are modelled as splits of one job; their templates are those of their own lines."""
    runs = cut(_runs(spark, sf))
    current, baseline = _current_and_baseline(runs)
    lines = cut(_run_lines(spark, sf).where(F.col("run_id").isin(baseline, current)))
    grouped = lines.select(F.col("run_id").alias("split"), F.col("artifact_id").alias("grp"), "signs")
    made = pt.md.cells(grouped, ["split", "grp"], pt.md.needed(cv.RANKED))
    figure = F.round("mean_log_likelihood_per_token", 9)
    best = cv.pooled(pt.md.leave_out(made, ["grp"], cv.RANKED)).groupBy(F.col("split").alias("run_id")).agg(
        F.min_by("model", F.struct(-figure, "model")).alias("best_model_label"), F.max(figure).alias("best_model")
    )
    covered = None
    for run in (baseline, current):
        own = lines.where(F.col("run_id") == run)
        row = tp.weighted_coverage(own, tp.templates(own, EVENT_SHARE))
        row = row.select(F.lit(run).alias("run_id"), F.col("coverage_of_all_lines").alias("coverage"))
        covered = row if covered is None else covered.unionByName(row)
    known = runs.join(best, "run_id").join(covered, "run_id")
    return cv.rounded(rn.delta_metrics(rn.registry(known), baseline, current))


@query(
    "run_initial_share_gains",
    f"""WITH {RUNS}, s AS (SELECT run_id, signs[1] AS sign, round(count(*)
        / sum(count(*)) OVER (PARTITION BY run_id), 6) AS f FROM rl GROUP BY run_id, signs[1])
    SELECT c.sign, coalesce(b.f, 0) AS before, c.f AS after,
      round(c.f - coalesce(b.f, 0), 6) AS gain FROM s c
    LEFT JOIN s b ON b.sign = c.sign AND b.run_id = (SELECT baseline_run FROM base)
    WHERE c.run_id = (SELECT run_id FROM cur) AND round(c.f - coalesce(b.f, 0), 6) > 0.004
    ORDER BY gain DESC, c.sign LIMIT 8""",
)
def run_initial_share_gains(spark, sf):
    lines = _run_lines(spark, sf)
    current, baseline = _current_and_baseline(cut(_runs(spark, sf)))
    shares = None
    for run in (baseline, current):
        part = pf.edge_frequency(lines.where(F.col("run_id") == run)).withColumn("run_id", F.lit(run))
        shares = part if shares is None else shares.unionByName(part)
    return rn.initial_share_gains(shares, baseline, current, shown=8)


@query(
    "run_publish_latest",
    f"WITH {RUNS} SELECT run_id, observations, canonical_entries, artifact_count FROM cur",
)
def run_publish_latest(spark, sf):
    root = f"{scratch_root(spark)}-{uuid.uuid4().hex[:6]}"
    runs = cut(_runs(spark, sf))
    current, baseline = _current_and_baseline(runs)
    columns = ["observations", "canonical_entries", "artifact_count"]
    for run in (current, baseline, current):  # the second write of a run replaces the first
        sinks.write_table(runs.where(F.col("run_id") == run), root, "runs", run, columns)
    return sinks.latest_run(sinks.read_table(spark, root, "runs"))


@query(
    "leaderboard_top10",
    """SELECT event_id, coalesce(nullif(trim(substr(trim('  user ' || user_id || ' by way of '
      || event_type || '  '), 1, 24)), ''), 'Player') AS name, value, ts FROM events
    ORDER BY value DESC, ts DESC, event_id LIMIT 10""",
)
def leaderboard_top10(spark, sf):
    label = F.concat(
        F.lit("  user "), "user_id", F.lit(" by way of "), "event_type", F.lit("  ")
    )
    return rn.leaderboard(corpora.table(spark, sf, "events"), label, "value", "ts", "event_id")
