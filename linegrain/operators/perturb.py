"""Deterministic perturbations of a corpus and what they do to the models.

All randomness is a hash of (line, place, seed): the same under any
partitioning and after any retry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linegrain.operators import cv
from linegrain.operators import models as md
from linegrain.scale import carry_forward, ordered_cumsum, ordered_index
from linegrain.session import cut

SEED = 101
CORRUPT = 0.20
DROP = 0.20
HOLDOUT = cv.HOLDOUT


def hash_number(*parts: Column) -> Column:
    """48 bits of an MD5 as an integer."""
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def primes_from(start: int, count: int) -> list[int]:
    """The first ``count`` primes from ``start`` on."""
    found: list[int] = []
    n = start | 1
    while len(found) < count:
        if all(n % d for d in range(3, int(n**0.5) + 1, 2)):
            found.append(n)
        n += 2
    return found


# Few numbers have more than 15 prime factors, so enough of these are coprime to any vocabulary.
MULTIPLIERS = primes_from(10_000, 64)


def vocabulary(lines: DataFrame) -> DataFrame:
    """Tokens with their counts."""
    tokens = lines.select(F.explode("signs").alias("token"))
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def _exploded(lines: DataFrame) -> DataFrame:
    return lines.select("line_id", F.posexplode("signs").alias("pos", "token"))


def _replaced(lines: DataFrame, tokens: DataFrame) -> DataFrame:
    """Lines with ``tokens (line_id, pos, token)`` in their places; other places stay."""
    at = F.map_from_entries(F.collect_list(F.struct("pos", "token")))
    moved = tokens.groupBy("line_id").agg(at.alias("_at"))
    signs = F.transform("signs", lambda t, i: F.coalesce(F.col("_at")[i], t))
    changed = lines.join(moved, "line_id", "left")
    return changed.withColumn("signs", F.when(F.col("_at").isNull(), F.col("signs")).otherwise(signs)).select(*lines.columns)


def global_relabel(lines: DataFrame, seed: int = SEED) -> DataFrame:
    """One bijection of the vocabulary for the whole corpus.

    Tokens in order of their text are matched with tokens in order of a hash.
    """
    vocab = vocabulary(lines).select("token")
    plain = ordered_index(vocab, ["token"], "place")
    key = F.md5(F.concat_ws("|", "token", F.lit(str(seed))))
    mixed = ordered_index(vocab.withColumn("_key", key), ["_key", "token"], "place")
    images = plain.join(mixed.select("place", F.col("token").alias("image")), "place").drop("place")
    moved = _exploded(lines).join(images, ["token"], "left").select(
        "line_id", "pos", F.col("image").alias("token")
    )
    return _replaced(lines, moved)


def shuffle_within_line(lines: DataFrame, seed: int = SEED) -> DataFrame:
    """The tokens of each line in another order."""
    keyed = F.transform(
        "signs",
        lambda t, i: F.struct(
            F.md5(F.concat_ws("|", F.col("line_id"), i.cast("string"), F.lit(str(seed)))).alias("k"),
            i.alias("i"),
            t.alias("t"),
        ),
    )
    return lines.withColumn("signs", F.transform(F.array_sort(keyed), lambda x: x["t"]))


def relabel_per_line(lines: DataFrame, seed: int = SEED) -> DataFrame:
    """Another bijection of the vocabulary for every line.

    Vocabulary places are mapped by place -> (a * place + b) mod V, with a
    coprime to V, so only the tokens at hand need images.
    """
    vocab = cut(ordered_index(vocabulary(lines).select("token"), ["token"], "place"))
    size = vocab.count()
    usable = [p for p in MULTIPLIERS if size % p] if size > 1 else [1]
    draw = hash_number(F.col("line_id"), F.lit(str(seed)))
    factor = F.get(F.array(*[F.lit(p).cast("long") for p in usable]), draw % len(usable))
    shift = F.shiftright(draw, 8) % max(1, size)
    placed = _exploded(lines).join(vocab, ["token"], "left").select(
        "line_id",
        "pos",
        ((factor * (F.col("place") - 1) + shift) % max(1, size) + 1).alias("place"),
    )
    return _replaced(lines, placed.join(vocab, ["place"], "left").select("line_id", "pos", "token"))


def redraw_tokens(lines: DataFrame, share: float, seed: int = SEED) -> DataFrame:
    """Replace each token, with probability ``share``, by a draw weighted by frequency.

    A weighted draw is a number below the corpus size; each token owns an
    interval as long as its count. Draws and the starts of intervals are sorted
    together, and the last start at or before a draw names its owner, so a draw
    meets one row whatever the counts are.
    """
    owners = cut(ordered_cumsum(vocabulary(lines), ["token"], "n", "start"))
    where = [F.col("line_id"), F.col("pos").cast("string")]
    hit = hash_number(*where, F.lit(f"{seed}hit")) % 1_000_000 < int(share * 1_000_000)
    total = F.coalesce(owners.agg(F.sum("n")).scalar(), F.lit(1))
    draws = _exploded(lines).where(hit).select(
        (hash_number(*where, F.lit(f"{seed}draw")) % total).alias("at"), "line_id", "pos", F.lit(None).cast("string").alias("owner")
    )
    starts = owners.select(
        F.col("start").alias("at"), F.lit(None).cast("string").alias("line_id"), F.lit(None).cast("int").alias("pos"),
        F.col("token").alias("owner"),
    )
    # NULL places come first: a start is before the draws of its number.
    drawn = carry_forward(draws.unionByName(starts), ["at", "line_id", "pos"], "owner", "image")
    drawn = drawn.where(F.col("line_id").isNotNull()).select("line_id", "pos", F.col("image").alias("token"))
    return _replaced(lines, drawn)


def is_external(kinds: str = "source_kind") -> Column:
    return F.contains(F.col(kinds), F.lit("external_csv"))


def drop_fraction(lines: DataFrame, share: float = DROP, seed: int = SEED) -> DataFrame:
    """Remove a share of the external lines; no lines at all, and so no test, below five of them."""
    external = lines.where(is_external())
    n = external.count()
    if n < 5:
        return lines.limit(0)
    key = F.md5(F.concat_ws("|", "line_id", F.lit(str(seed))))
    dealt = ordered_index(external.withColumn("_key", key), ["_key", "line_id"], "_n")
    kept = dealt.where(F.col("_n") > max(1, round(share * n))).select(*lines.columns)
    return lines.where(~is_external()).unionByName(kept)


def _mean_over_groups(scored: DataFrame) -> DataFrame:
    each = F.col("ll") / F.greatest(F.lit(1), "tokens")
    return scored.groupBy("model").agg(
        F.count(F.lit(1)).alias("groups"), F.avg(each).alias("mean_log_likelihood_per_token")
    )


def genre_cross_prediction(lines: DataFrame, models: Sequence[str] = cv.RANKED) -> DataFrame:
    """Train on one artifact prefix, test on all others; the mean over prefixes, if two or more."""
    prefix = F.regexp_extract("artifact_id", "^([A-Z]+)", 1)
    grouped = lines.withColumn("grp", F.coalesce(F.nullif(prefix, F.lit("")), F.lit("UNK")))
    made = md.cells(grouped, ["grp"], md.needed(models))
    return _mean_over_groups(md.cross_groups(made, "grp", models))


def corpus_cross_prediction(lines: DataFrame, models: Sequence[str] = cv.RANKED) -> DataFrame:
    """Own material predicts imported material and the other way round."""
    grouped = lines.withColumn("grp", F.when(is_external(), "external").otherwise("internal"))
    made = md.cells(grouped, ["grp"], md.needed(models))
    return _mean_over_groups(md.cross_groups(made, "grp", models))


# Kind of test and what it should do, by test.
SUITE = {
    "randomized_sign_relabel_global": ("adversarial_control", "small_change_allowed"),
    "shuffled_sequence_control": ("falsification", "substantial_degradation"),
    "randomized_sign_relabel_per_line": ("falsification", "substantial_degradation"),
    "genre_split_cross_prediction": ("generalization", "moderate_degradation"),
    "cross_corpus_segmentation": ("generalization", "moderate_degradation"),
    "remove_20pct_external_random": ("stability", "small_to_moderate_change"),
    "normalization_mode_identity": ("stability", "small_to_moderate_change"),
    "normalization_mode_permissive": ("stability", "small_to_moderate_change"),
}


def suite(
    lines: DataFrame, model: str, modes: dict[str, DataFrame] | None = None, seed: int = SEED
) -> DataFrame:
    """All stress tests of one model under leave-one-artifact-out.

    Every perturbed corpus is one split of a single job. ``modes`` has the
    lines of other normalization modes.
    """
    variants = {
        "baseline": lines,
        "randomized_sign_relabel_global": global_relabel(lines, seed),
        "shuffled_sequence_control": shuffle_within_line(lines, seed),
        "randomized_sign_relabel_per_line": relabel_per_line(lines, seed),
        "remove_20pct_external_random": drop_fraction(lines, DROP, seed),
    }
    for mode, other in (modes or {}).items():
        variants[f"normalization_mode_{mode}"] = other
    stacked = None
    for name, df in variants.items():
        part = df.select(F.lit(name).alias("split"), F.col("artifact_id").alias("grp"), "signs")
        stacked = part if stacked is None else stacked.unionByName(part)
    made = md.cells(stacked, ["split", "grp"], md.needed([model]))
    folds = cv.pooled(md.leave_out(made, ["grp"], [model])).select(
        F.col("split").alias("test_name"), "model", F.col("mean_log_likelihood_per_token").alias("ll")
    )
    crossed = [
        ("genre_split_cross_prediction", genre_cross_prediction(lines, [model])),
        ("cross_corpus_segmentation", corpus_cross_prediction(lines, [model])),
    ]
    for name, df in crossed:
        folds = folds.unionByName(
            df.where("groups >= 2").select(
                F.lit(name).alias("test_name"), "model",
                F.col("mean_log_likelihood_per_token").alias("ll"),
            )
        )
    folds = cut(folds)
    base = folds.where("test_name = 'baseline'").agg(F.max("ll")).scalar()
    kind = F.create_map(*[F.lit(x) for n, (k, _) in SUITE.items() for x in (n, k)])
    expected = F.create_map(*[F.lit(x) for n, (_, e) in SUITE.items() for x in (n, e)])
    rows = folds.where("test_name <> 'baseline'").withColumn("base", base)
    ll, before = F.col("ll"), F.col("base")
    return rows.select(
        "test_name",
        kind[F.col("test_name")].alias("test_type"),
        "model",
        before.alias("baseline_log_likelihood"),
        ll.alias("perturbed_log_likelihood"),
        (ll - before).alias("delta_log_likelihood"),
        F.exp(-before).alias("baseline_perplexity"),
        F.exp(-ll).alias("perturbed_perplexity"),
        (F.exp(-ll) - F.exp(-before)).alias("delta_perplexity"),
        expected[F.col("test_name")].alias("expected_behavior"),
    )


def largest_drop(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.min_by("test_name", F.struct("delta_log_likelihood", "test_name")).alias("test_name"),
        F.min("delta_log_likelihood").alias("delta_log_likelihood"),
    )


# What the in-sample tests should do to models of order.
IN_SAMPLE = {
    "within_line_shuffle": "should_degrade_for_order_sensitive_models",
    "random_20pct_token_corruption": "should_degrade_moderately",
    "length_preserving_frequency_sample": "should_degrade_strongly",
    "global_label_permutation_scored_against_original": "should_degrade_if_sign_identity_matters",
}
NULL_EXPECTATION = "small_change_expected_for_frequency_only_null"


def in_sample_suite(
    lines: DataFrame, models: Sequence[str] = HOLDOUT, seed: int = SEED
) -> DataFrame:
    """Perturbed corpora scored by the models of the untouched corpus."""
    variants = {
        "baseline": lines,
        "within_line_shuffle": shuffle_within_line(lines, seed),
        "random_20pct_token_corruption": redraw_tokens(lines, CORRUPT, seed),
        "length_preserving_frequency_sample": redraw_tokens(lines, 1.0, seed + 1),
        "global_label_permutation_scored_against_original": global_relabel(lines, seed),
    }
    stacked = None
    for name, df in variants.items():
        part = df.select(F.lit(name).alias("test_name"), "signs")
        stacked = part if stacked is None else stacked.unionByName(part)
    kinds = md.needed(models)
    test = cut(md.cells(stacked, ["test_name"], kinds))
    train = test.where("test_name = 'baseline'").drop("test_name")
    scored = cut(
        md.transfer(train, test, ["test_name"], models).select(
            "test_name", "model", (F.col("ll") / F.col("tokens")).alias("ll")
        )
    )
    base = scored.where("test_name = 'baseline'").select("model", F.col("ll").alias("base"))
    # One row per model, four in all.
    rows = scored.where("test_name <> 'baseline'").join(F.broadcast(base), "model")
    delta = F.col("ll") - F.col("base")
    frequency_only = (F.col("model") == "unigram") & (
        F.col("test_name") != "global_label_permutation_scored_against_original"
    )
    expected = F.create_map(*[F.lit(x) for pair in IN_SAMPLE.items() for x in pair])
    passed = F.when(frequency_only, F.abs(delta) < 0.05).otherwise(delta < -0.05)
    return rows.select(
        "test_name",
        "model",
        F.col("base").alias("baseline_ll_per_token"),
        F.col("ll").alias("perturbed_ll_per_token"),
        delta.alias("delta_ll_per_token"),
        F.exp(-F.col("base")).alias("baseline_perplexity"),
        F.exp(-F.col("ll")).alias("perturbed_perplexity"),
        F.when(frequency_only, NULL_EXPECTATION)
        .otherwise(expected[F.col("test_name")])
        .alias("expected_behavior"),
        passed.cast("int").alias("passed"),
    )
