"""Whole runs: ingest, structural analysis and deep validation, written as tables by run."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linegrain.functions import text as tx
from linegrain.operators import classify as cl
from linegrain.operators import components as cc
from linegrain.operators import cv
from linegrain.operators import normalize as nz
from linegrain.operators import perturb as pt
from linegrain.operators import profiles as pf
from linegrain.operators import runs as rn
from linegrain.operators import scorecard as sc
from linegrain.operators import similarity as sm
from linegrain.operators import stats as st
from linegrain.operators import templates as tp
from linegrain.operators import validate as va
from linegrain.session import cut
from linegrain.sources import files, sinks

PIVOT, PIVOT_LENGTH, PIVOT_POSITION, STEM = "AB22", 4, 3, "KU RA2"


def collect_observations(
    documents: DataFrame, external: DataFrame | None = None, row_no: str = "row_number"
) -> DataFrame:
    """Numbered observations of landed documents, followed by imported rows."""
    own = files.file_observations(documents)
    own = own.withColumn("external_no", F.lit(0))
    if external is not None:
        more = files.external_observations(external, row_no).withColumns(
            {
                "is_md": F.lit(False),
                "kind_rank": F.lit(0),
                "note_no": F.lit(0),
                "external_no": F.col("line_no"),
            }
        )
        own = own.unionByName(more)
    # Own material has no external number and comes first; imported rows keep their file's order.
    order = ["external_no", *files.FILE_ORDER]
    return files.number_observations(own, order).select(
        "observation_id", *files.OBSERVATION_COLUMNS
    )


def suite_lines(lines: DataFrame) -> DataFrame:
    """Canonical lines with the columns that models and stress tests use."""
    key = F.concat_ws("|", "artifact_id", "canonical_sequence", "quantity_key")
    return lines.select(
        F.md5(key).alias("line_id"),
        "artifact_id",
        "signs",
        "quantity",
        F.col("source_kinds").alias("source_kind"),
        "origin_count",
    )


def run_structural(
    spark: SparkSession,
    observations: DataFrame,
    variants: DataFrame,
    root: str,
    run_id: str,
    mode: str = "strict",
) -> DataFrame:
    """The full structural run. Writes every table under ``root`` and returns the summary row."""
    observations = cut(observations)

    def write(name: str, df: DataFrame) -> DataFrame:
        sinks.write_table(df, root, name, run_id)
        return sinks.read_table(spark, root, name, run_id).drop("run_id")

    found = nz.normalize(observations, variants, mode)
    log = write("mapping_log", nz.mapping_log(observations, variants, (mode,)))
    flags = write("uncertainty_flags", nz.flags(log))
    lines = write("canonical_lines", found["lines"].drop("line_key", *nz.CHANGES))
    links = cut(found["links"].drop("line_key"))
    write("manifest_lists", nz.manifest_lists(links))
    write("provenance_links", links.select("canonical_line_id", "observation_id"))
    write("observation_view", found["view"].drop("line_key", *nz.CHANGES))
    write("corpus_manifest", nz.manifest(lines, links))
    write("canonical_corpus", nz.canonical_corpus(lines, links))
    write("variant_collisions", nz.variant_collisions(log))
    write("normalization_summary", nz.flag_summary(log, flags))

    work = cut(suite_lines(lines))
    for n, name in ((1, "sign"), (2, "bigram"), (3, "trigram")):
        write(f"{name}_frequency", pf.ngram_frequency(work, n, name))
    write("initial_position_frequency", pf.edge_frequency(work))
    write("terminal_position_frequency", pf.edge_frequency(work, terminal=True))
    for suffix in (False, True):
        name = "suffix" if suffix else "prefix"
        write(f"{name}_patterns", pf.edge_patterns(work, suffix))
        write(f"{name}_pattern_artifacts", pf.edge_pattern_artifacts(work, suffix))

    types = write("sequence_types", tp.sequence_types(work))
    pairs = write("similarity_edges", sm.similar_pairs(types))
    write("clusters", cc.clusters(types, pairs))
    templates = write("structural_templates", tp.templates(work))
    coverage = tp.weighted_coverage(work, templates)

    position = cut(st.pivot_support(st.position_test(work, PIVOT, PIVOT_LENGTH, PIVOT_POSITION)))
    stems = cut(st.stem_support(work))
    write("pivot_support", position)
    write("stem_support", stems)
    write("pivot_followers", st.pivot_followers(work))
    metrics = write("structural_metrics", st.structural_metrics(work))

    bakeoff = write("model_bakeoff", cv.bakeoff(work, cut(st.alignment(metrics))))
    combined = bakeoff.where("cv_scheme = 'combined'")
    winner = combined.where("is_best_model = 1").first()["model"]
    modes = {
        other: cut(suite_lines(nz.canonical_lines(nz.observation_view(observations, variants, (other,)))))
        for other in ("identity", "permissive")
    }
    suite = write("stress_suite", pt.suite(work, winner, modes))

    supported = write("hypotheses", sc.hypotheses(position, stems.where(F.col("stem") == STEM)))
    inputs = sc.inputs(work, flags, log, coverage, combined, suite, supported)
    scored = cut(sc.scored(inputs))
    write("score_components", sc.components(scored))
    write("score_sensitivity", sc.weight_sweep(scored))
    write("scored", scored)
    external = observations.where(pt.is_external()).agg(F.count(F.lit(1))).scalar()
    summary = sc.gate(scored).withColumns(
        {
            "run_utc": F.lit(datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")),
            "normalization_mode": F.lit(mode),
            "observations_all_sources": observations.agg(F.count(F.lit(1))).scalar(),
            "external_rows_loaded": external,
            "winner_model_id": F.lit(winner),
        }
    )
    best = combined.where("is_best_model = 1").select(F.col("overall_goodness_score").alias("best_model"))
    summary = summary.withColumnsRenamed({"lines": "canonical_entries", "artifacts": "artifact_count"}).withColumns(
        {
            "run_id": F.lit(run_id),
            "coverage": coverage.select("coverage_of_all_lines").scalar(),
            "structural_confidence": scored.select("structural_confidence").scalar(),
            "best_model": best.scalar(),
        }
    )
    summary = cut(summary)
    sinks.write_summary(summary, root, run_id)
    numbers = summary.withColumnsRenamed({"observations_all_sources": "observations", "winner_model_id": "best_model_label"})
    sinks.write_table(rn.registry(numbers), root, "run_registry", run_id)
    compare_with_baseline(spark, root, run_id)
    return summary


def compare_with_baseline(spark: SparkSession, root: str, run_id: str) -> str | None:
    """Picks the run to compare with, writes what changed since, and points ``latest_run`` at the last run.

    A first run has no baseline and no delta. Only two runs are read beyond the
    registry, which has some rows for each run.
    """
    known = sinks.read_table(spark, root, "run_registry")
    imported = rn.registered(known, "external_rows_loaded")
    latest = sinks.latest_run(known.select("run_id").distinct())
    sinks.write_table(latest.select(F.col("run_id").alias("latest")), root, "latest_run", "pointer")
    baseline = rn.pick_baseline(imported, run_id).first()["baseline_run"]
    if baseline is None:
        return None
    delta = rn.delta_metrics(known, baseline, run_id).withColumn("baseline_run", F.lit(baseline))
    sinks.write_table(delta, root, "run_delta", run_id)
    shares = sinks.read_table(spark, root, "initial_position_frequency").where(F.col("run_id").isin(baseline, run_id))
    sinks.write_table(rn.initial_share_gains(shares, baseline, run_id), root, "initial_share_gains", run_id)
    return baseline


def run_ingest(
    spark: SparkSession, raw: DataFrame, stored: DataFrame, known: DataFrame, root: str, run_id: str
) -> dict[str, DataFrame]:
    """Validate imported rows and merge them into the stored corpus.

    Everything is written before the gate is checked; a closed gate raises and
    leaves the stored corpus as it was.
    """
    checked = va.validate(raw, known)
    sinks.write_table(raw, root, "raw_import", run_id)
    for name in ("issues", "rows", "summary"):
        sinks.write_table(checked[name], root, f"validation_{name}", run_id)
    summary = sinks.read_table(spark, root, "validation_summary", run_id)
    va.require_gate(summary)
    now = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    old = cut(va.normalize_stored(stored))
    new = sinks.read_table(spark, root, "validation_rows", run_id).drop("run_id")
    sinks.write_table(va.merge_lists(old, new, now), root, "external_corpus_lists", run_id)
    sinks.write_table(va.merge(old, new, now), root, "external_corpus", run_id)
    return {
        "summary": summary,
        "merged": sinks.read_table(spark, root, "external_corpus", run_id).drop("run_id"),
    }


def inventory_of(observations: DataFrame, stored: DataFrame, variants: DataFrame) -> DataFrame:
    """Every token that is known already."""
    return va.inventory(
        observations.select(F.explode(tx.tokens(F.col("sign_sequence")))),
        stored.select(F.explode(tx.tokens(F.col("sign_sequence")))),
        variants.select("variant"),
        variants.select("canonical"),
    )


def run_deep_validation(spark: SparkSession, root: str, run_id: str) -> dict[str, DataFrame]:
    """Attribute holdouts, in-sample stress, inventories and tiers over a structural run."""
    lines = sinks.read_table(spark, root, "canonical_lines", run_id)
    tags = sinks.read_table(spark, root, "manifest_lists", run_id)
    tags = nz.list_cell(tags, "provenance_tags").withColumnRenamed("provenance_tags", "provenance")
    base = lines.join(tags, "canonical_line_id", "left").select(
        F.col("canonical_line_id").alias("line_id"), "artifact_id", "signs", "quantity", "provenance"
    )
    entries = cut(cl.attributes(base))

    def write(name: str, df: DataFrame) -> DataFrame:
        sinks.write_table(df, root, name, run_id)
        return sinks.read_table(spark, root, name, run_id).drop("run_id")

    metadata = write("artifact_metadata", cl.artifact_metadata(base))
    holdout = write("strict_model_comparison", cv.against_baseline(cv.attribute_holdout(entries)))
    stress = write("in_sample_stress", pt.in_sample_suite(entries))
    scored = sinks.read_table(spark, root, "scored", run_id)
    return {
        "metadata": metadata,
        "coverage": write("metadata_coverage", cl.metadata_coverage(metadata)),
        "formulas": write("formula_inventory", cl.formula_inventory(metadata)),
        "anchors": write("anchor_inventory", cl.anchor_support(entries, ["line_id"])),
        "holdout": holdout,
        "stress": stress,
        "tiers": write("confidence_tiers", sc.tiers(sc.tier_inputs(entries, holdout, stress, scored))),
    }
