"""Position and stem tests, structural metrics and their alignment with expectations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linegrain.functions import text as tx
from linegrain.operators.templates import position_counts
from linegrain.scale import list_pages

METRICS = [
    "positional_entropy_norm", "first_token_concentration", "template_dominance",
    "bigram_predictability",
]
# What each hypothesis expects of the four metrics, in their order.
TARGETS = {
    "unigram": (0.78, 0.25, 0.35, 0.40),
    "first_bigram": (0.56, 0.50, 0.50, 0.62),
    "position": (0.38, 0.58, 0.82, 0.74),
}


def _position_subset(lines: DataFrame, token: str, length: int, position: int) -> DataFrame:
    held = lines.where((F.size("signs") == length) & F.array_contains("signs", token))
    return held.select(
        F.size(F.filter("signs", lambda t: t == token)).alias("k"),
        (F.get("signs", F.lit(position - 1)) == token).alias("hit"),
    )


def position_expectation(lines: DataFrame, token: str, length: int, position: int) -> DataFrame:
    """How often ``token`` stands at ``position``, and the mean over shuffles inside lines.

    A shuffle puts one of k equal tokens on a slot with probability k / length.
    """
    return _position_subset(lines, token, length, position).agg(
        F.count(F.lit(1)).alias("observed_total"),
        F.count_if("hit").alias("observed_count"),
        F.round(F.coalesce(F.sum("k"), F.lit(0)) / length, 6).alias("expected_mean_under_null"),
    )


#: Rounds of shuffles that the p-value of a test is the expectation of, and frequencies that one row stands for.
ROUNDS, FREQUENCIES = 5000, 4096


def _tail_term(m: Column, n: Column, s: Column, classes: Column, length: int) -> Column:
    """One frequency's share of P(X >= s), X being a sum of n independent hits.

    With phi the characteristic function of X and theta = 2 pi m / (n + 1), the
    probabilities are the inverse transform of phi at n + 1 frequencies, and the
    sum of a tail over its terms is a geometric series:
    -|phi| sin(theta s / 2) / sin(theta / 2) cos(arg phi - theta (s - 1) / 2).
    """
    theta = F.lit(2 * math.pi) * m / (n + 1)

    def total(part) -> Column:
        return F.aggregate(classes, F.lit(0.0), lambda acc, c: acc + c["n"] * part(c["k"] / F.lit(float(length))))

    size = total(lambda p: 0.5 * F.ln(F.greatest(F.lit(1e-300), (1 - p) * (1 - p) + p * p + 2 * p * (1 - p) * F.cos(theta))))
    turn = total(lambda p: F.atan2(p * F.sin(theta), 1 - p + p * F.cos(theta)))
    # m s is taken modulo 2 (n + 1), so that large products keep their digits.
    half = F.lit(math.pi) * ((m * s) % (2 * (n + 1))) / (n + 1)
    term = -F.exp(size) * F.sin(half) / F.sin(theta / 2) * F.cos(turn - half + theta / 2)
    return F.when(m == 0, (n + 1 - s).cast("double")).otherwise(term)


def position_test(
    lines: DataFrame, token: str, length: int, position: int, rounds: int = ROUNDS
) -> DataFrame:
    """One-sided test of ``token`` at ``position`` in lines of ``length``, against shuffles inside lines.

    A line with k of the tokens hits with probability k / length, so a round of
    shuffles is a sum of unequal hits. Its tail is exact: the corpus is reduced
    to one row per k, and a sum over frequencies, dealt out in rows, gives the
    probability. The p-value is what ``rounds`` rounds give on average, the
    observed round counted in.
    """
    subset = _position_subset(lines, token, length, position)
    by_k = subset.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"))
    classes = by_k.agg(
        F.array_sort(F.collect_list(F.struct("k", "n"))).alias("classes"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("observed_total"),
        F.coalesce(F.sum("hits"), F.lit(0)).alias("observed_count"),
        F.round(F.coalesce(F.sum(F.col("k") * F.col("n")), F.lit(0)) / length, 6).alias("mean"),
    )
    n, s = F.col("observed_total"), F.col("observed_count")
    first = F.explode(F.sequence(F.lit(0).cast("long"), n, F.lit(FREQUENCIES).cast("long"))).alias("first")
    rows = classes.select("*", first).repartition("first")
    last = F.least(n, F.col("first") + FREQUENCIES - 1)
    each = rows.select("*", F.explode(F.sequence(F.col("first"), last)).alias("m"))
    term = _tail_term(F.col("m"), n, s, F.col("classes"), length)
    rolled = each.groupBy("observed_total", "observed_count", "mean").agg((F.sum(term) / (F.max(n) + 1)).alias("tail"))
    tail = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("tail")))
    p = (tail * rounds + 1) / (rounds + 1)
    return rolled.select(
        "observed_total",
        "observed_count",
        F.col("mean").alias("expected_mean_under_null"),
        F.when(n == 0, 1.0).otherwise(p).alias("p_value_ge_observed"),
    )


def _stems(lines: DataFrame) -> DataFrame:
    return lines.where(F.size("signs") >= 2).select(
        F.array_join(F.slice("signs", 1, 2), " ").alias("stem"),
        F.array_join("signs", " ").alias("form"),
        F.coalesce(F.get("signs", F.lit(2)), F.lit("<ZERO>")).alias("ending"),
        "artifact_id",
    )


def stem_endings(lines: DataFrame) -> DataFrame:
    """Forms, endings, lines and artifacts of every two-token stem."""
    return _stems(lines).groupBy("stem").agg(
        F.count_distinct("form").alias("form_count"),
        F.count_distinct("ending").alias("ending_count"),
        F.count(F.lit(1)).alias("line_count"),
        F.count_distinct("artifact_id").alias("artifact_count"),
    )


def stem_ending_lists(lines: DataFrame) -> DataFrame:
    return list_pages(_stems(lines), ["stem"], "ending")


def pivot_followers(lines: DataFrame, length: int = 4, position: int = 3) -> DataFrame:
    """What follows each token at ``position`` in lines of ``length``."""
    held = lines.where(F.size("signs") == length)
    return held.groupBy(
        F.get("signs", F.lit(position - 1)).alias("pivot"),
        F.get("signs", F.lit(position)).alias("follower"),
    ).agg(F.count(F.lit(1)).alias("count"))


def pivot_support(test: DataFrame) -> DataFrame:
    """Score of a position test, at most 84."""
    n = F.greatest(F.lit(1.0), F.col("observed_total").cast("double"))
    score = 100.0 * (
        0.45 * (F.col("observed_count") / n)
        + 0.30 * (1.0 - F.col("p_value_ge_observed"))
        + 0.25 * F.least(F.lit(1.0), F.col("observed_total") / 12.0)
    )
    return test.withColumn("support", F.round(F.least(F.lit(84.0), score), 6))


def stem_support(lines: DataFrame) -> DataFrame:
    """Score of every stem, at most 78."""
    all_of = lines.agg(
        F.struct(F.count(F.lit(1)).alias("lines"), F.count_distinct("artifact_id").alias("artifacts"))
    ).scalar()
    score = 100.0 * (
        0.50 * F.least(F.lit(1.0), F.col("ending_count") / 5.0)
        + 0.30 * (F.col("line_count") / F.greatest(F.lit(1), F.col("whole.lines")))
        + 0.20 * (F.col("artifact_count") / F.greatest(F.lit(1), F.col("whole.artifacts")))
    )
    scored = stem_endings(lines).withColumn("whole", all_of)
    return scored.select("stem", F.round(F.least(F.lit(78.0), score), 6).alias("support"))


def _entropy(count: str, total: Column) -> Column:
    p = F.col(count) / total
    return -F.sum(p * F.ln(p + F.lit(1e-15)))


def _relative(entropy: Column, kinds: Column) -> Column:
    """Entropy over its maximum; with one kind the maximum is taken as 1e-12."""
    return entropy / F.when(kinds > 1, F.ln(kinds)).otherwise(F.lit(1e-12))


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def structural_metrics(lines: DataFrame) -> DataFrame:
    """The four metrics of a corpus in one row."""
    counts = position_counts(lines)
    sizes = counts.where("position = 0").groupBy("length").agg(F.sum("n").alias("block"))
    slots = (
        counts.join(sizes, "length")
        .groupBy("length", "position", "block")
        .agg(
            _entropy("n", F.col("block")).alias("h"),
            F.count(F.lit(1)).alias("kinds"),
            F.max("n").alias("top"),
        )
    )
    weighted = slots.agg(
        (F.sum(_relative(F.col("h"), F.col("kinds")) * F.col("block")) / F.sum("block")).alias("e"),
        (F.sum(F.col("top")) / F.sum("block")).alias("d"),
    )
    firsts = lines.groupBy(F.get("signs", F.lit(0)).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    first = firsts.agg(F.max("n") / F.sum("n")).scalar()
    pairs = lines.select(F.explode(tx.ngrams(F.col("signs"), 2)).alias("g"))
    pairs = pairs.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    total = pairs.agg(F.sum("n")).scalar()
    bigram = pairs.withColumn("total", total).agg(
        (1.0 - _relative(_entropy("n", F.col("total")), F.count(F.lit(1)))).alias("b")
    )
    return weighted.select(
        _unit(F.coalesce("e", F.lit(0.0))).alias(METRICS[0]),
        _unit(F.coalesce(first, F.lit(0.0))).alias(METRICS[1]),
        _unit(F.coalesce("d", F.lit(0.0))).alias(METRICS[2]),
        _unit(F.coalesce(bigram.scalar(), F.lit(0.0))).alias(METRICS[3]),
    )


def alignment(metrics: DataFrame) -> DataFrame:
    """How close the metrics are to what each hypothesis expects, 0 to 100."""
    rows = []
    for model, targets in TARGETS.items():
        gap = sum(F.abs(F.col(m) - F.lit(t)) for m, t in zip(METRICS, targets, strict=True))
        rows.append(F.struct(F.lit(model).alias("model"), (100.0 * (1.0 - gap / 4)).alias("alignment")))
    return metrics.select(F.inline(F.array(*rows)))
