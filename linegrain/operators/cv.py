"""Cross-validation schemes, comparison with the baseline, and the ranking of models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linegrain.operators import models as md
from linegrain.scale import ordered_index

SEED = 20260224
RANKED = ("unigram", "first_bigram", "position")
HOLDOUT = ("unigram", "bigram", "trigram", "position")
# Splits by attribute, with the fewest lines that a test fold may have.
SPLITS = {
    "artifact_held_out": ("artifact_id", 4),
    "site_held_out": ("site", 10),
    "region_held_out": ("region", 10),
    "object_class_held_out": ("object_class", 10),
    "formula_class_held_out": ("formula_class", 10),
    "inscription_length_held_out": ("length_bucket", 10),
}


def pooled(folds: DataFrame, by: Sequence[str] = ("split", "model")) -> DataFrame:
    """One figure over all folds: total log-likelihood per token, and its perplexity."""
    rolled = folds.groupBy(*by).agg(
        F.count(F.lit(1)).alias("folds"),
        F.sum("lines").alias("test_lines"),
        F.sum("tokens").alias("test_tokens"),
        (F.sum("ll") / F.sum("tokens")).alias("mean_log_likelihood_per_token"),
    )
    return rolled.withColumn("perplexity", F.exp(-F.col("mean_log_likelihood_per_token")))


def leave_one_group_out(
    lines: DataFrame, group: str = "artifact_id", models: Sequence[str] = RANKED
) -> DataFrame:
    grouped = lines.withColumns(
        {"split": F.lit("leave_one_artifact_out"), "grp": F.col(group)}
    )
    made = md.cells(grouped, ["split", "grp"], md.needed(models))
    return pooled(md.leave_out(made, ["grp"], models))


def fold_of(lines: DataFrame, k: int, seed: int = SEED) -> DataFrame:
    """Lines dealt into ``k`` folds in the order of a hash, so that sizes differ by one at most."""
    key = F.md5(F.concat_ws("|", "line_id", F.lit(str(seed))))
    dealt = ordered_index(lines.withColumn("_key", key), ["_key", "line_id"], "_n").drop("_key")
    return dealt.withColumn("fold", ((F.col("_n") - 1) % k).cast("int")).drop("_n")


def kfold(lines: DataFrame, models: Sequence[str] = RANKED, seed: int = SEED) -> DataFrame:
    """Five folds from 35 lines on, else three; no rows below 18 lines."""
    n = lines.limit(35).count()
    dealt = fold_of(lines, 5 if n >= 35 else 3, seed)
    grouped = dealt.withColumns({"split": F.lit("kfold"), "grp": F.col("fold").cast("string")})
    made = md.cells(grouped, ["split", "grp"], md.needed(models))
    result = pooled(md.leave_out(made, ["grp"], models))
    return result if n >= 18 else result.limit(0)


def attribute_holdout(entries: DataFrame, models: Sequence[str] = HOLDOUT) -> DataFrame:
    """Every attribute as a split, its values as folds; folds are averaged, not pooled.

    Small values are no folds but stay in the training side of the others.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(s).alias("split"), F.col(c).alias("grp"), F.lit(least).alias("least"))
            for s, (c, least) in SPLITS.items()
        ]
    )
    long = entries.select("signs", F.inline(pairs))
    made = md.cells(long, ["split", "grp"], md.needed(models))
    scored = md.leave_out(made, ["grp"], models)
    least = F.create_map(*[F.lit(x) for s, (_, n) in SPLITS.items() for x in (s, n)])
    kept = scored.where(F.col("lines") >= least[F.col("split")])
    mean = F.col("ll") / F.greatest(F.lit(1), "tokens")
    return kept.groupBy("split", "model").agg(
        F.count(F.lit(1)).alias("folds"),
        F.sum("lines").alias("test_lines"),
        F.sum("tokens").alias("test_tokens"),
        F.round(F.avg(mean), 6).alias("mean_log_likelihood_per_token"),
        F.round(F.avg(F.exp(-mean)), 6).alias("perplexity"),
    )


def against_baseline(holdout: DataFrame, baseline: str = "unigram") -> DataFrame:
    """Gain over the baseline of the same split; a split has one row per model."""
    ll = F.col("mean_log_likelihood_per_token")
    base = F.max(F.when(F.col("model") == baseline, ll)).over(W.partitionBy("split"))
    gain = F.coalesce(ll - base, F.lit(0.0))
    return holdout.withColumns(
        {
            "ll_improvement_over_unigram": F.round(gain, 6),
            "beats_unigram": F.when(gain > 0.01, 1).otherwise(0),
        }
    )


def ranked(schemes: DataFrame, alignment: DataFrame) -> DataFrame:
    """Rank score within a scheme (0 worst, 100 best), blended with the alignment score."""
    within = W.partitionBy("split")
    ll = F.col("mean_log_likelihood_per_token")
    low, high = F.min(ll).over(within), F.max(ll).over(within)
    rank = F.when(high > low, 100.0 * (ll - low) / (high - low)).otherwise(50.0)
    # The alignment table has one row per hypothesis, three in all.
    joined = schemes.join(F.broadcast(alignment), "model").withColumn("cv_rank_score", rank)
    return joined.withColumn(
        "overall_goodness_score", 0.65 * F.col("cv_rank_score") + 0.35 * F.col("alignment")
    ).withColumnRenamed("split", "cv_scheme")


def combined(rows: DataFrame) -> DataFrame:
    """Means over the schemes of each model, with the best model marked."""
    means = ["mean_log_likelihood_per_token", "perplexity", "alignment", "cv_rank_score", "overall_goodness_score"]
    rolled = rows.groupBy("model").agg(
        F.lit("combined").alias("cv_scheme"),
        *[F.sum(c).alias(c) for c in ("folds", "test_lines", "test_tokens")],
        *[F.avg(c).alias(c) for c in means],
    )
    best = W.orderBy(F.col("overall_goodness_score").desc(), "model")
    # Three rows, one per model.
    return rolled.withColumn("is_best_model", (F.row_number().over(best) == 1).cast("int"))


def bakeoff(lines: DataFrame, alignment: DataFrame) -> DataFrame:
    """Scores per scheme and combined."""
    schemes = leave_one_group_out(lines).unionByName(kfold(lines))
    rows = ranked(schemes, alignment)
    return rows.withColumn("is_best_model", F.lit(0)).unionByName(combined(rows))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at the precision of the published tables."""
    out: list[Column] = [
        F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes
    ]
    return df.select(*out)
