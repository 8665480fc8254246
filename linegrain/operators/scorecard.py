"""Scores of a whole corpus out of the tables of the other operators.

``inputs`` is a table with one row per scored corpus, so the same expressions
score one corpus or many.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linegrain.operators.perturb import hash_number

# Weights of the components.
WEIGHTS = {
    "corpus_adequacy_score": 0.25,
    "normalization_stability_score": 0.20,
    "template_predictability_score": 0.20,
    "out_of_sample_performance_score": 0.20,
    "adversarial_robustness_score": 0.15,
}
CAP = 84.99
SHIFT = 0.08
FLOOR = 0.01
DRAWS = 400
BENIGN = [
    "randomized_sign_relabel_global", "normalization_mode_identity",
    "normalization_mode_permissive",
]
DESTRUCTIVE = ["shuffled_sequence_control", "randomized_sign_relabel_per_line"]
GUARDS = ["cross_corpus_segmentation", "remove_20pct_external_random", *DESTRUCTIVE]


# Hypotheses that are claimed, not measured, with their kind and confidence.
CLAIMS = (("H-P1", "phonetic mapping", 18.0), ("H-M1", "semantic mapping", 29.0))


def hypotheses(
    pivots: DataFrame, stems: DataFrame, claims: Sequence[tuple[str, str, float]] = CLAIMS
) -> DataFrame:
    """(hypothesis_id, analysis_type, confidence_percent): the best pivot, the best stem, and what is claimed.

    ``pivots`` and ``stems`` have a ``support``; without rows it is 0.
    """

    def best(rows: DataFrame, name: str) -> DataFrame:
        return rows.agg(F.coalesce(F.max("support"), F.lit(0.0)).alias("confidence_percent")).select(
            F.lit(name).alias("hypothesis_id"), F.lit("structural mapping").alias("analysis_type"), "confidence_percent"
        )

    found = best(pivots, "H-S1").unionByName(best(stems, "H-S2"))
    if not claims:
        return found
    rows = [F.struct(*[F.lit(x).alias(c) for c, x in zip(found.columns, claim, strict=True)]) for claim in claims]
    return found.unionByName(found.limit(1).select(F.inline(F.array(*rows))))


def inputs(
    lines: DataFrame,
    flags: DataFrame,
    events: DataFrame,
    coverage: DataFrame,
    combined: DataFrame,
    suite: DataFrame,
    supported: DataFrame,
) -> DataFrame:
    """The one-row input table of a corpus. ``lines`` needs ``origin_count``.

    ``supported`` has the hypotheses; the best structural and the best semantic
    support are compared by the gate.
    """
    ll = F.col("mean_log_likelihood_per_token")

    def of_model(column: Column, model: str) -> Column:
        return F.max(F.when(F.col("model") == model, column))

    models = combined.agg(
        F.struct(
            F.max(F.when(F.col("is_best_model") == 1, ll)).alias("winner_ll"),
            of_model(ll, "unigram").alias("unigram_ll"),
            of_model(F.col("alignment"), "position").alias("position_alignment"),
        )
    ).scalar()
    delta, after = F.col("delta_log_likelihood"), F.col("perturbed_log_likelihood")

    def of_test(column: Column, test: str) -> Column:
        return F.max(F.when(F.col("test_name") == test, column))

    tests = suite.agg(
        F.struct(
            of_test(after, "normalization_mode_identity").alias("identity_ll"),
            of_test(after, "normalization_mode_permissive").alias("permissive_ll"),
            F.avg(F.when(F.col("test_name").isin(BENIGN), F.abs(delta))).alias("benign"),
            F.avg(F.when(F.col("test_name").isin(DESTRUCTIVE), F.abs(delta))).alias("destructive"),
            F.min(F.when(F.col("test_name").isin(GUARDS), delta)).alias("guard_delta"),
        )
    ).scalar()
    base = lines.agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_distinct("artifact_id").alias("artifacts"),
        F.sum("origin_count").alias("sources"),
    )
    row = base.withColumns(
        {
            "m": models,
            "t": tests,
            "flag_count": flags.agg(F.count(F.lit(1))).scalar(),
            "event_count": events.agg(F.count(F.lit(1))).scalar(),
            "coverage": coverage.select("coverage_of_all_lines").scalar(),
            "c": supported.agg(F.struct(_best_of("structural"), _best_of("semantic"))).scalar(),
        }
    )
    return row.select(
        "lines", "artifacts", "sources", "m.*", "t.*", "flag_count", "event_count", "coverage",
        "c.*",
    )


def _best_of(kind: str) -> Column:
    matching = F.when(F.startswith("analysis_type", F.lit(kind)), F.col("confidence_percent"))
    return F.coalesce(F.max(matching), F.lit(0.0)).alias(f"{kind}_confidence")


def _capped_ratio(value: str, full: float) -> Column:
    return F.least(F.lit(1.0), F.col(value) / full)


def component_columns() -> dict[str, Column]:
    drift = (
        F.abs(F.coalesce("identity_ll", "winner_ll") - F.col("winner_ll"))
        + F.abs(F.coalesce("permissive_ll", "winner_ll") - F.col("winner_ll"))
    ) / 2.0
    flagged = F.col("flag_count") / F.greatest(F.lit(1), "event_count")
    gain = F.col("winner_ll") - F.col("unigram_ll")
    retained = F.coalesce(F.exp(-F.col("benign")), F.lit(0.0))
    separated = F.coalesce(F.least(F.lit(1.0), F.col("destructive") / 0.8), F.lit(0.0))
    return {
        "corpus_adequacy_score": 0.55 * _capped_ratio("lines", 150.0)
        + 0.25 * _capped_ratio("artifacts", 20.0)
        + 0.20 * _capped_ratio("sources", 200.0),
        "normalization_stability_score": F.greatest(
            F.lit(0.0), 1.0 - F.least(F.lit(1.0), drift)
        )
        * (1.0 - F.least(F.lit(0.5), flagged)),
        "template_predictability_score": 0.6 * F.col("position_alignment") / 100.0
        + 0.4 * F.col("coverage"),
        "out_of_sample_performance_score": 1.0 / (1.0 + F.exp(-6.0 * gain)),
        "adversarial_robustness_score": 0.5 * retained + 0.5 * separated,
    }


def scored(input_rows: DataFrame) -> DataFrame:
    """Inputs with their components, the raw score, the gate, and the final score."""
    with_parts = input_rows.withColumns(component_columns())
    parts = [F.col(c) for c in WEIGHTS]
    raw = 100.0 * sum(F.col(c) * w for c, w in WEIGHTS.items())
    least = F.least(*parts)
    gate = (
        (F.col("lines") >= 80) & (F.col("artifacts") >= 12) & (least >= 0.70)
        & (F.col("out_of_sample_performance_score") >= 0.70)
    )
    rows = with_parts.withColumns({"raw_score": raw, "strict_gate": gate, "least_component": least})
    gated = F.when(F.col("strict_gate"), F.col("raw_score")).otherwise(
        F.least("raw_score", F.lit(CAP))
    )
    stronger = F.col("semantic_confidence") > F.col("structural_confidence")
    rows = rows.withColumns({"gated_score": gated, "semantic_stronger": stronger})
    rows = rows.withColumn("guard_triggered", (F.col("gated_score") >= 85.0) | stronger)
    collapse = F.col("guard_triggered") & F.coalesce(F.col("guard_delta") <= -0.45, F.lit(False))
    rows = rows.withColumn("guard_collapse", collapse)
    limiting = F.filter(
        F.array(
            F.when(F.col("lines") < 80, "corpus_size"),
            F.when(F.col("artifacts") < 12, "artifact_diversity"),
            F.when(F.col("least_component") < 0.70, "component_convergence"),
            F.when(F.col("guard_collapse"), "stress_guard_collapse"),
        ),
        lambda x: x.isNotNull(),
    )
    final = F.when(F.col("guard_collapse"), F.least("gated_score", F.lit(CAP)))
    return rows.withColumns(
        {
            "final_score": F.coalesce(final, F.col("gated_score")),
            "limiting_factors": F.array_join(limiting, ","),
        }
    )


def components(scored_rows: DataFrame) -> DataFrame:
    """One row per component with its score, weight and contribution."""
    rows = [
        F.struct(
            F.lit(c).alias("component"),
            F.round(c, 6).alias("score"),
            F.lit(w).alias("weight"),
            F.round(F.col(c) * w * 100.0, 6).alias("contribution"),
        )
        for c, w in WEIGHTS.items()
    ]
    return scored_rows.select(F.inline(F.array(*rows)))


def gate(scored_rows: DataFrame) -> DataFrame:
    return scored_rows.select(
        "lines",
        "artifacts",
        F.round("raw_score", 6).alias("raw_score"),
        F.round("final_score", 6).alias("final_score"),
        "strict_gate",
        (F.col("final_score") >= 85.0).alias("threshold_85_reached"),
        "semantic_stronger",
        "guard_triggered",
        "guard_collapse",
        F.round(F.when(F.col("guard_triggered"), F.col("guard_delta")), 6).alias("guard_min_delta"),
        "limiting_factors",
    )


def weight_sweep(scored_rows: DataFrame, draws: int = DRAWS, seed: int = 303) -> DataFrame:
    """Raw and capped score under other weights: base, one at a time, and random ones.

    The weightings are generated inside each scored row, so corpora are never
    joined with a weight table.
    """
    names = list(WEIGHTS)

    def scenario(name: Column, kind: str, weights: list[Column]) -> Column:
        total = sum(weights[1:], weights[0])
        return F.struct(
            name.alias("scenario_id"),
            F.lit(kind).alias("scenario_type"),
            *[(w / total).alias(f"w_{c}") for c, w in zip(names, weights, strict=True)],
        )

    fixed = [scenario(F.lit("base"), "base_weights", [F.lit(w) for w in WEIGHTS.values()])]
    for name in names:
        for sign, label in ((-1, "minus"), (1, "plus")):
            shifted = {**WEIGHTS, name: max(FLOOR, WEIGHTS[name] + sign * SHIFT)}
            fixed.append(
                scenario(
                    F.lit(f"oat_{name}_{label}"), "one_at_a_time", [F.lit(w) for w in shifted.values()]
                )
            )
    size = float(1 << 48)

    def draw(i: Column) -> Column:
        parts = [
            hash_number(i.cast("string"), F.lit(f"{j}"), F.lit(str(seed))) / size + FLOOR
            for j in range(len(names))
        ]
        return scenario(F.format_string("rand_%03d", i), "random_weights", parts)

    random = F.transform(F.sequence(F.lit(1), F.lit(draws)), draw)
    each = scored_rows.select(
        *names, "strict_gate", F.explode(F.concat(F.array(*fixed), random)).alias("w")
    )
    raw = 100.0 * sum(F.col(c) * F.col(f"w.w_{c}") for c in names)
    capped = F.when(F.col("strict_gate"), F.col("raw")).otherwise(F.least("raw", F.lit(CAP)))
    return each.withColumn("raw", raw).select(
        "w.scenario_id",
        "w.scenario_type",
        *[F.round(f"w.w_{c}", 6).alias(f"w_{c}") for c in names],
        F.round("raw", 6).alias("raw_score"),
        F.round(capped, 6).alias("capped_score"),
    )


def tier_inputs(
    lines: DataFrame, holdout: DataFrame, in_sample: DataFrame, scored_rows: DataFrame
) -> DataFrame:
    """One row with what the confidence tiers are made of. ``lines`` needs site and provenance."""
    unknown = F.size(F.filter("signs", lambda t: F.contains(t, F.lit("[?]"))))
    base = lines.agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_distinct("artifact_id").alias("artifacts"),
        F.count_distinct("site").alias("sites"),
        (F.count_if(F.coalesce("provenance", F.lit("")) != "") / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("provenance_share"),
        (F.sum(unknown) / F.greatest(F.lit(1), F.sum(F.size("signs")))).alias("unknown_rate"),
    )
    gain = holdout.where("model <> 'unigram'").agg(F.avg("ll_improvement_over_unigram")).scalar()
    order = (F.col("test_name") == "within_line_shuffle") & (F.col("model") != "unigram")
    drop = in_sample.where(order).agg(F.min("delta_ll_per_token")).scalar()
    parts = scored_rows.select(
        F.struct(
            F.col("normalization_stability_score").alias("stability"),
            F.col("template_predictability_score").alias("template"),
            F.col("adversarial_robustness_score").alias("robustness"),
        )
    ).scalar()
    row = base.withColumns({"gain": gain, "order_drop": drop, "p": parts})
    return row.select("*", "p.*").drop("p")


def band(percent: Column) -> Column:
    return (
        F.when(percent >= 85, "high")
        .when(percent >= 70, "medium-high")
        .when(percent >= 50, "medium")
        .when(percent >= 25, "low")
        .otherwise("very low")
    )


def tiers(tier_rows: DataFrame) -> DataFrame:
    """Confidence tiers with their bands."""

    def unit(x: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))

    oos = unit(0.50 + F.coalesce("gain", F.lit(0.0)) / 1.20)
    order = unit(F.abs(F.coalesce("order_drop", F.lit(0.0))) / 0.65)
    corpus = (
        0.30 * _capped_ratio("lines", 2500.0)
        + 0.25 * _capped_ratio("artifacts", 600.0)
        + 0.20 * F.col("provenance_share")
        + 0.15 * _capped_ratio("sites", 20.0)
        + 0.10 * (1.0 - F.least(F.lit(0.5), F.col("unknown_rate")))
    )
    norm = unit(F.col("stability") - F.col("unknown_rate"))
    structure = 0.35 * oos + 0.30 * order + 0.20 * F.col("robustness") + 0.15 * F.col("template")
    overall = (
        0.25 * corpus + 0.20 * norm + 0.25 * structure + 0.15 * F.col("template") + 0.15 * oos
    )
    named = {
        "corpus_adequacy_confidence": corpus,
        "normalization_confidence": norm,
        "structural_script_confidence": structure,
        "template_predictability_confidence": F.col("template"),
        "out_of_sample_prediction_confidence": oos,
        "overall_structural_confidence": overall,
    }
    rows = [
        F.struct(F.lit(n).alias("tier"), (s * 100.0).alias("score")) for n, s in named.items()
    ]
    each = tier_rows.select(F.inline(F.array(*rows)))
    percent = F.greatest(F.lit(0.0), F.least(F.lit(99.0), F.col("score")))
    return each.select(
        "tier", F.round(percent, 2).alias("confidence_percent"), band(percent).alias("label")
    )
