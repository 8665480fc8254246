"""Comparison of runs, and a top list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAIN = 0.004
#: Numbers of a run that are compared, where a run has them; a label says which one a number belongs to.
RUN_METRICS = [
    "observations", "canonical_entries", "artifact_count", "external_rows_loaded", "coverage", "final_score",
    "structural_confidence", "best_model",
]


def pick_baseline(runs: DataFrame, current: str) -> DataFrame:
    """The run to compare ``current`` with.

    Of the earlier runs: the last without imported rows, else the last with
    less than half of today's imported rows, else the last. ``runs`` has
    ``run_id`` (sorts by time) and ``external_rows_loaded``.
    """
    now = runs.where(F.col("run_id") == current).agg(F.max("external_rows_loaded")).scalar()
    ext = F.col("external_rows_loaded")
    rule = (
        F.when((F.col("now") > 0) & (ext == 0), 3)
        .when((F.col("now") > 0) & (ext < F.floor(F.col("now") * 0.5)), 2)
        .otherwise(1)
    )
    earlier = runs.where(F.col("run_id") < current).withColumn("now", now).withColumn("rule", rule)
    key = F.struct("rule", "run_id")
    return earlier.agg(F.max_by("run_id", key).alias("baseline_run"), F.max("rule").alias("rule"))


def registry(runs: DataFrame) -> DataFrame:
    """(run_id, metric, value, label): a row for each number that a run has.

    ``runs`` has a row for each run; ``<metric>_label`` may stand beside a
    metric, such as the name of the best model beside its figure.
    """

    def cell(metric: str) -> Column:
        label = F.col(f"{metric}_label") if f"{metric}_label" in runs.columns else F.lit(None)
        return F.struct(F.lit(metric).alias("metric"), F.col(metric).cast("double").alias("value"), label.cast("string").alias("label"))

    cells = F.array(*[cell(m) for m in RUN_METRICS if m in runs.columns])
    return runs.select("run_id", F.inline(cells)).where(F.col("value").isNotNull() | F.col("label").isNotNull())


def registered(rows: DataFrame, metric: str) -> DataFrame:
    """(run_id, ``metric``) of all runs of a registry."""
    return rows.where(F.col("metric") == metric).select("run_id", F.col("value").alias(metric))


def delta_metrics(rows: DataFrame, baseline: str, current: str) -> DataFrame:
    """Before, after and difference of every metric that either run of a registry has."""

    def side(run: str, name: str) -> DataFrame:
        return rows.where(F.col("run_id") == run).select("metric", F.col("value").alias(name), F.col("label").alias(f"{name}_label"))

    joined = side(baseline, "before").join(side(current, "after"), "metric", "full")
    return joined.select("metric", "before", "after", (F.col("after") - F.col("before")).alias("delta"), "before_label", "after_label")


def initial_share_gains(
    shares: DataFrame, baseline: str, current: str, shown: int | None = None
) -> DataFrame:
    """Initial tokens that gained most since the baseline run; a token that was missing had none.

    ``shares`` has run_id, sign and relative_frequency. ``shown`` keeps the
    largest gains alone, for a report.
    """
    before = shares.where(F.col("run_id") == baseline).select(
        "sign", F.col("relative_frequency").alias("was")
    )
    now = shares.where(F.col("run_id") == current).select(
        "sign", F.col("relative_frequency").alias("after")
    )
    joined = now.join(before, "sign", "left").withColumn("before", F.coalesce("was", F.lit(0.0)))
    gains = joined.select(
        "sign", "before", "after", F.round(F.col("after") - F.col("before"), 6).alias("gain")
    )
    ordered = gains.where(F.col("gain") > GAIN).orderBy(F.desc("gain"), "sign")
    return ordered if shown is None else ordered.limit(shown)


def leaderboard(rows: DataFrame, name: Column, score: str, time: str, tie: str) -> DataFrame:
    """The ten best scores; later ones first among equals."""
    shown = F.coalesce(F.nullif(F.trim(F.substring(F.trim(name), 1, 24)), F.lit("")), F.lit("Player"))
    best = rows.orderBy(F.desc(score), F.desc(time), F.asc(tie)).limit(10)
    return best.select(tie, shown.alias("name"), score, time)
