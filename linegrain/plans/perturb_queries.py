"""Stress tests over event lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from linegrain.checks import corpus_sql as q
from linegrain.operators import cv
from linegrain.operators import normalize as nz
from linegrain.operators import perturb as pt
from linegrain.plans.model_queries import loo_sql, pooled_sql
from linegrain.plans.normalize_queries import lines_sql
from linegrain.plans.registry import query
from linegrain.session import cut
from linegrain.sources import corpora, files

SEED = pt.SEED
# A variant map for the tokens of coded event lines.
EVENT_VARIANTS = [("A12", "AB22", "exact", 0.9, ""), ("RO", "KU", "uncertain", 0.35, "")]


def hash_sql(*parts: str) -> str:
    return f"('0x' || substr(md5({' || chr(124) || '.join(parts)}), 1, 12))::BIGINT"


def vocab_sql(src: str) -> str:
    return f"""voc AS (SELECT token, count(*) AS n, row_number() OVER (ORDER BY token) AS place,
      row_number() OVER (ORDER BY md5(token || '|{SEED}'), token) AS mixed,
      sum(count(*)) OVER (ORDER BY token) - count(*) AS start
    FROM (SELECT unnest(signs) AS token FROM {src}) GROUP BY token),
  img AS (SELECT a.token, b.token AS image FROM voc a JOIN voc b ON a.place = b.mixed),
  vs AS (SELECT v, total, list(p ORDER BY p) AS ps FROM (SELECT count(*) AS v,
      sum(n)::BIGINT AS total FROM voc), (SELECT unnest({pt.MULTIPLIERS}) AS p)
    WHERE v % p <> 0 GROUP BY v, total),
  tk AS (SELECT line_id, unnest(signs) AS token, generate_subscripts(signs, 1) - 1 AS pos
    FROM {src})"""


RELABEL = "g_map AS (SELECT line_id, list(image ORDER BY pos) AS signs FROM tk JOIN img USING (token) GROUP BY line_id)"
SHUFFLE = f"""s_map AS (SELECT line_id, list(token ORDER BY md5(line_id || '|' || pos || '|{SEED}'),
    pos) AS signs FROM tk GROUP BY line_id)"""
PER_LINE = f"""dr AS (SELECT tk.*, place - 1 AS r, {hash_sql("line_id", f"'{SEED}'")} AS h, v, ps
    FROM tk JOIN voc USING (token), vs),
  pl AS (SELECT line_id, pos, (ps[h % len(ps) + 1] * r + (h >> 8) % v) % v + 1 AS place FROM dr),
  p_map AS (SELECT line_id, list(token ORDER BY pos) AS signs FROM pl JOIN voc USING (place)
    GROUP BY line_id)"""


def redraw_sql(name: str, share: float, seed: int) -> str:
    place = "line_id", "pos::VARCHAR"
    return f"""{name}_d AS (SELECT tk.*, {hash_sql(*place, f"'{seed}hit'")} % 1000000
      < {int(share * 1_000_000)} AS hit, {hash_sql(*place, f"'{seed}draw'")} % total AS draw
    FROM tk, vs),
  {name} AS (SELECT line_id, list(CASE WHEN hit THEN voc.token ELSE d.token END ORDER BY pos)
      AS signs FROM {name}_d d JOIN voc ON draw >= start AND draw < start + n GROUP BY line_id)"""


def drop_sql(src: str) -> str:
    return f"""kept AS (SELECT * EXCLUDE (rn, m) FROM (SELECT *, row_number() OVER (
        ORDER BY md5(line_id || '|{SEED}'), line_id) AS rn, count(*) OVER () AS m FROM {src}
      WHERE contains(source_kind, 'external_csv'))
      WHERE m >= 5 AND rn > greatest(1, round_even(0.2 * m, 0))
    UNION ALL SELECT * FROM {src} WHERE NOT contains(source_kind, 'external_csv'))"""


def _events(spark, sf):
    return cut(corpora.event_lines(spark, sf))


def _coded(spark, sf):
    return cut(corpora.coded_lines(spark, sf))


def _shown(lines):
    return lines.select("line_id", F.array_join("signs", " ").alias("signs"))


def _lines_sql(parts: list[str], name: str) -> str:
    return f"""WITH {q.EV}, {vocab_sql("ev")}, {", ".join(parts)}
    SELECT line_id, array_to_string(signs, ' ') AS signs FROM {name}"""


@query("pert_global_relabel", _lines_sql([RELABEL], "g_map"))
def pert_global_relabel(spark, sf):
    return _shown(pt.global_relabel(_events(spark, sf)))


@query("pert_shuffle_within_line", _lines_sql([SHUFFLE], "s_map"))
def pert_shuffle_within_line(spark, sf):
    return _shown(pt.shuffle_within_line(corpora.event_lines(spark, sf)))


@query("pert_relabel_per_line", _lines_sql([PER_LINE], "p_map"))
def pert_relabel_per_line(spark, sf):
    return _shown(pt.relabel_per_line(_events(spark, sf)))


@query("pert_corrupt_tokens", _lines_sql([redraw_sql("c_map", 0.2, SEED)], "c_map"))
def pert_corrupt_tokens(spark, sf):
    return _shown(pt.redraw_tokens(_events(spark, sf), pt.CORRUPT))


@query("pert_frequency_sample", _lines_sql([redraw_sql("f_map", 1.0, SEED + 1)], "f_map"))
def pert_frequency_sample(spark, sf):
    return _shown(pt.redraw_tokens(_events(spark, sf), 1.0, SEED + 1))


def cross_sql(name: str, src: str, grp: str) -> str:
    """Every group's model on every cell of the others, spelled out."""
    return f"""{name}_in AS (SELECT {grp} AS grp, signs FROM {src}),
  {q.cells(f"{name}_own", f"{name}_in", ["grp"])},
  {name}_z AS (SELECT grp, count(*) FILTER (kind = 'uni') AS v, count(*) FILTER (kind = 'len') AS k,
    sum(n) FILTER (kind = 'uni') AS tokens, sum(n) FILTER (kind = 'len') AS lines
    FROM {name}_own GROUP BY grp),
  {name}_x AS (SELECT grp, kind, ctx, sum(n) AS n_ctx FROM {name}_own GROUP BY ALL),
  {name}_p AS (SELECT z.grp, t.kind, t.n, coalesce(o.n, 0) AS c, coalesce(x.n_ctx, 0) AS n_ctx,
      coalesce(u.n, 0) AS u, z.tokens, 0.35::DOUBLE * (CASE WHEN t.kind = 'len' THEN z.k
        ELSE greatest(1, z.v) END + 1) AS w
    FROM {name}_z z JOIN {name}_own t ON t.grp <> z.grp
    LEFT JOIN {name}_own o ON o.grp = z.grp AND o.kind = t.kind AND o.ctx = t.ctx AND o.tok = t.tok
    LEFT JOIN {name}_x x ON x.grp = z.grp AND x.kind = t.kind AND x.ctx = t.ctx
    LEFT JOIN {name}_own u ON u.grp = z.grp AND u.kind = 'uni' AND u.tok = t.tok),
  {name}_g AS (SELECT grp, model, sum(n * CASE WHEN kind = 'pos' AND n_ctx = 0
      THEN ln((u + 0.35::DOUBLE) / (tokens + w)) ELSE ln((c + 0.35::DOUBLE) / (n_ctx + w)) END) AS ll
    FROM {name}_p JOIN mk USING (kind) GROUP BY grp, model),
  {name} AS (SELECT model, count(*) AS groups, avg(ll / ((SELECT sum(tokens) FROM {name}_z)
      - tokens)) AS mean_log_likelihood_per_token FROM {name}_g JOIN {name}_z USING (grp)
    GROUP BY model)"""


_CROSS_COLS = """model, groups, round(mean_log_likelihood_per_token, 6)
  AS mean_log_likelihood_per_token"""
GENRE = "coalesce(nullif(regexp_extract(artifact_id, '^([A-Z]+)', 1), ''), 'UNK')"
CORPUS = "CASE WHEN contains(source_kind, 'external_csv') THEN 'external' ELSE 'internal' END"


@query(
    "pert_group_cross_prediction",
    f"WITH {q.CODED}, {q.MODEL_KINDS}, {cross_sql('cg', 'coded', GENRE)} SELECT {_CROSS_COLS} FROM cg",
)
def pert_group_cross_prediction(spark, sf):
    scored = pt.genre_cross_prediction(_coded(spark, sf), tuple(pt.md.MODELS))
    return cv.rounded(scored)


@query(
    "pert_cross_corpus",
    f"WITH {q.CODED}, {q.MODEL_KINDS}, {cross_sql('cc', 'coded', CORPUS)} SELECT {_CROSS_COLS} FROM cc",
)
def pert_cross_corpus(spark, sf):
    return cv.rounded(pt.corpus_cross_prediction(_coded(spark, sf), tuple(pt.md.MODELS)))


_POOLED = """split, model, folds, test_lines, test_tokens, round(mean_log_likelihood_per_token, 6)
  AS mean_log_likelihood_per_token, round(perplexity, 6) AS perplexity"""


@query(
    "pert_drop_fraction",
    f"""WITH {q.CODED}, {q.MODEL_KINDS}, {drop_sql("coded")}, {loo_sql("kept")}
    SELECT {_POOLED} FROM ({pooled_sql("loo")}) WHERE model IN ('unigram', 'first_bigram', 'position')""",
)
def pert_drop_fraction(spark, sf):
    return cv.rounded(cv.leave_one_group_out(pt.drop_fraction(_coded(spark, sf))))


@query(
    "pert_normalization_mode",
    f"""WITH {lines_sql(("identity", "permissive"))}, {q.MODEL_KINDS},
      mode_in AS (SELECT mode AS split, artifact_id AS grp, signs FROM lines),
      {q.cells("mode_own", "mode_in", ["split", "grp"])},
      {q.leave_out("modes", "mode_own", ["grp"])}
    SELECT {_POOLED} FROM ({pooled_sql("modes")}) WHERE model IN ('unigram', 'first_bigram', 'position')""",
)
def pert_normalization_mode(spark, sf):
    modes = ("identity", "permissive")
    obs = corpora.observations(spark, sf).where("sign_sequence <> ''")
    view = nz.observation_view(obs, corpora.variants(spark, sf), modes)
    lines = nz.canonical_lines(view, ["mode"])
    grouped = lines.select(F.col("mode").alias("split"), F.col("artifact_id").alias("grp"), "signs")
    made = pt.md.cells(grouped, ["split", "grp"], pt.md.needed(cv.RANKED))
    return cv.rounded(cv.pooled(pt.md.leave_out(made, ["grp"], cv.RANKED)))


def coded_observations(spark, sf):
    """Coded event lines as observations of a corpus."""
    return corpora.coded_lines(spark, sf).select(
        F.col("line_id").alias("observation_id"),
        F.col("provenance").alias("source_id"),
        "source_kind",
        "artifact_id",
        "line_id",
        F.lit(1).alias("line_no"),
        F.array_join("signs", " ").alias("sign_sequence"),
        "quantity",
        "provenance",
        F.lit("").alias("notes"),
    )


def event_variants(spark):
    rows = [(*v[:3], str(v[3]), v[4]) for v in EVENT_VARIANTS]
    return files.variant_map(spark.createDataFrame(rows, files.VARIANT_COLUMNS))


def mode_lines(spark, sf, mode: str):
    """Canonical lines of the coded corpus, with the columns that the suite needs."""
    view = nz.observation_view(coded_observations(spark, sf), event_variants(spark), (mode,))
    lines = nz.canonical_lines(view)
    key = F.concat_ws("|", "artifact_id", "canonical_sequence", "quantity_key")
    return cut(
        lines.select(
            F.md5(key).alias("line_id"),
            "artifact_id",
            "signs",
            "quantity",
            F.col("source_kinds").alias("source_kind"),
            "origin_count",
        )
    )


def _mode_sql(mode: str) -> str:
    to = {"identity": "t", "strict": "CASE t WHEN 'A12' THEN 'AB22' ELSE t END",
          "permissive": "CASE t WHEN 'A12' THEN 'AB22' WHEN 'RO' THEN 'KU' ELSE t END"}[mode]
    return f"""mode_{mode} AS (SELECT md5(artifact_id || '|' || array_to_string(signs, ' ') || '|'
      || coalesce(quantity::VARCHAR, '')) AS line_id, artifact_id, signs, quantity, source_kind
    FROM (SELECT DISTINCT artifact_id, list_transform(signs, lambda t: {to}) AS signs, quantity,
      source_kind FROM coded))"""


SUITE_TABLES = f"""{q.CODED}, {q.MODEL_KINDS}, {_mode_sql("strict")}, {_mode_sql("identity")},
  {_mode_sql("permissive")}, {vocab_sql("mode_strict")}, {RELABEL}, {SHUFFLE}, {PER_LINE},
  {drop_sql("mode_strict")},
  st_in AS (
    SELECT 'baseline' AS split, artifact_id AS grp, signs FROM mode_strict
    UNION ALL SELECT 'randomized_sign_relabel_global', artifact_id, g.signs FROM mode_strict
      JOIN g_map g USING (line_id)
    UNION ALL SELECT 'shuffled_sequence_control', artifact_id, g.signs FROM mode_strict
      JOIN s_map g USING (line_id)
    UNION ALL SELECT 'randomized_sign_relabel_per_line', artifact_id, g.signs FROM mode_strict
      JOIN p_map g USING (line_id)
    UNION ALL SELECT 'remove_20pct_external_random', artifact_id, signs FROM kept
    UNION ALL SELECT 'normalization_mode_identity', artifact_id, signs FROM mode_identity
    UNION ALL SELECT 'normalization_mode_permissive', artifact_id, signs FROM mode_permissive),
  {q.cells("st_own", "st_in", ["split", "grp"])}, {q.leave_out("st", "st_own", ["grp"])},
  {cross_sql("cg", "mode_strict", GENRE)}, {cross_sql("cc", "mode_strict", CORPUS)},
  st_all AS (SELECT split AS test_name, model, sum(ll) / sum(tokens) AS ll FROM st GROUP BY ALL
    UNION ALL SELECT 'genre_split_cross_prediction', model, mean_log_likelihood_per_token FROM cg
    UNION ALL SELECT 'cross_corpus_segmentation', model, mean_log_likelihood_per_token FROM cc)"""


def suite_sql(model: str) -> str:
    """The suite of the model that the SQL expression ``model`` names."""
    kinds = " ".join(f"WHEN '{n}' THEN '{k}'" for n, (k, _) in pt.SUITE.items())
    wanted = " ".join(f"WHEN '{n}' THEN '{e}'" for n, (_, e) in pt.SUITE.items())
    return f"""suite AS (SELECT test_name, CASE test_name {kinds} END AS test_type,
      model, base AS baseline_log_likelihood, ll AS perturbed_log_likelihood,
      ll - base AS delta_log_likelihood, exp(-base) AS baseline_perplexity,
      exp(-ll) AS perturbed_perplexity, exp(-ll) - exp(-base) AS delta_perplexity,
      CASE test_name {wanted} END AS expected_behavior FROM st_all, (SELECT ll AS base FROM st_all
        WHERE test_name = 'baseline' AND model = {model})
    WHERE model = {model} AND test_name <> 'baseline')"""


_SUITE_COLS = """test_name, test_type, model, round(baseline_log_likelihood, 6)
    AS baseline_log_likelihood, round(perturbed_log_likelihood, 6) AS perturbed_log_likelihood,
    round(delta_log_likelihood, 6) AS delta_log_likelihood,
    round(baseline_perplexity, 6) AS baseline_perplexity,
    round(perturbed_perplexity, 6) AS perturbed_perplexity,
    round(delta_perplexity, 6) AS delta_perplexity, expected_behavior"""
MODEL = "position"
MODEL_SQL = f"'{MODEL}'"


def coded_suite(spark, sf, model: str = MODEL):
    modes = {m: mode_lines(spark, sf, m) for m in ("identity", "permissive")}
    return pt.suite(mode_lines(spark, sf, "strict"), model, modes)


@query("pert_scoreboard", f"WITH {SUITE_TABLES}, {suite_sql(MODEL_SQL)} SELECT {_SUITE_COLS} FROM suite")
def pert_scoreboard(spark, sf):
    return cv.rounded(coded_suite(spark, sf))


@query(
    "pert_largest_drop",
    f"""WITH {SUITE_TABLES}, {suite_sql(MODEL_SQL)} SELECT test_name, round(delta_log_likelihood, 6)
      AS delta_log_likelihood FROM suite ORDER BY delta_log_likelihood, test_name LIMIT 1""",
)
def pert_largest_drop(spark, sf):
    return cv.rounded(pt.largest_drop(coded_suite(spark, sf)))


def in_sample_sql(tables: str = q.EV, src: str = "ev") -> str:
    """Tables up to ``insample``, for the lines ``src`` of ``tables``."""
    wanted = " ".join(f"WHEN '{n}' THEN '{e}'" for n, e in pt.IN_SAMPLE.items())
    free = """model = 'unigram' AND test_name
      <> 'global_label_permutation_scored_against_original'"""
    return f"""{tables}, {q.MODEL_KINDS}, {vocab_sql(src)}, {RELABEL}, {SHUFFLE},
  {redraw_sql("c_map", 0.2, SEED)}, {redraw_sql("f_map", 1.0, SEED + 1)},
  is_in AS (SELECT 'baseline' AS test_name, signs FROM {src}
    UNION ALL SELECT 'within_line_shuffle', signs FROM s_map
    UNION ALL SELECT 'random_20pct_token_corruption', signs FROM c_map
    UNION ALL SELECT 'length_preserving_frequency_sample', signs FROM f_map
    UNION ALL SELECT 'global_label_permutation_scored_against_original', signs FROM g_map),
  {q.cells("tr", src, [])}, {q.cells("te", "is_in", ["test_name"])},
  {q.transfer("isr", "tr", "te", ["test_name"])},
  per AS (SELECT test_name, model, ll / tokens AS ll FROM isr JOIN isr_z USING (test_name)
    WHERE model <> 'first_bigram'),
  insample AS (SELECT p.test_name, model, b.ll AS base, p.ll, p.ll - b.ll AS delta,
    CASE WHEN {free.replace("test_name", "p.test_name")} THEN '{pt.NULL_EXPECTATION}'
      ELSE CASE p.test_name {wanted} END END AS expected_behavior,
    CASE WHEN {free.replace("test_name", "p.test_name")} THEN abs(p.ll - b.ll) < 0.05
      ELSE p.ll - b.ll < -0.05 END::INT AS passed
    FROM per p JOIN (SELECT model, ll FROM per WHERE test_name = 'baseline') b USING (model)
    WHERE p.test_name <> 'baseline')"""


@query(
    "pert_scoreboard_insample",
    f"""WITH {in_sample_sql()} SELECT test_name, model, round(base, 6) AS baseline_ll_per_token,
      round(ll, 6) AS perturbed_ll_per_token, round(delta, 6) AS delta_ll_per_token,
      round(exp(-base), 6) AS baseline_perplexity, round(exp(-ll), 6) AS perturbed_perplexity,
      expected_behavior, passed FROM insample""",
)
def pert_scoreboard_insample(spark, sf):
    return cv.rounded(pt.in_sample_suite(_events(spark, sf)))
