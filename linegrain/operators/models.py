"""Smoothed sequence models as count tables.

A model is a set of cells ``(kind, ctx, tok) -> n``. Each kind of cell is one
factor of a model: ``len`` line lengths, ``uni`` tokens, ``first`` first
tokens, ``bi`` and ``tri`` tokens after one and two others, ``pos`` tokens by
length and position. A log-likelihood splits into a part over cells and a part
over contexts,

    sum c ln(C + a)  -  sum n_ctx ln(N_ctx + a (V + 1)),

so held-out folds, foreign corpora and single lines are all scored by joins of
count tables. Leaving a group out subtracts its counts; nothing is refitted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linegrain.session import cut, stored

ALPHA = 0.35
BOS = "<BOS>"
MODELS = {
    "unigram": ("len", "uni"),
    "first_bigram": ("len", "first", "bi"),
    "bigram": ("len", "bi"),
    "trigram": ("len", "tri"),
    "position": ("len", "pos"),
}
CELL = ["kind", "ctx", "tok"]


def features(kinds: Sequence[str] | None = None) -> Column:
    """The cells of one line, with repeats, as an array of (kind, ctx, tok)."""
    s, n = F.col("signs"), F.size("signs")

    def cell(kind: str, ctx: Column, tok: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), ctx.alias("ctx"), tok.alias("tok"))

    def back(i: Column, k: int) -> Column:
        return F.when(i >= k, F.get(s, i - k)).otherwise(F.lit(BOS))

    none = F.lit("")
    made = {
        "len": lambda: F.array(cell("len", none, n.cast("string"))),
        "first": lambda: F.array(cell("first", none, F.get(s, F.lit(0)))),
        "uni": lambda: F.transform(s, lambda t: cell("uni", none, t)),
        "bi": lambda: F.transform(s, lambda t, i: cell("bi", back(i, 1), t)),
        "tri": lambda: F.transform(
            s, lambda t, i: cell("tri", F.concat_ws(" ", back(i, 2), back(i, 1)), t)
        ),
        "pos": lambda: F.transform(
            s, lambda t, i: cell("pos", F.concat_ws(":", n.cast("string"), i.cast("string")), t)
        ),
    }
    return F.concat(*[made[k]() for k in (kinds or made)])


def cells(lines: DataFrame, by: Sequence[str] = (), kinds: Sequence[str] | None = None) -> DataFrame:
    """Counts of cells by the columns ``by``; combines map-side before it shuffles."""
    each = lines.select(*by, F.inline(features(kinds)))
    return each.groupBy(*by, *CELL).agg(F.count(F.lit(1)).alias("n"))


def needed(models: Sequence[str]) -> list[str]:
    """Kinds of cells that the models use; ``uni`` always, for the vocabulary."""
    kinds = {"len", "uni"}
    for m in models:
        kinds |= set(MODELS[m])
    return sorted(kinds)


def _sizes(cell: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group: distinct tokens and lengths, and total tokens and lines."""
    uni, length = F.col("kind") == "uni", F.col("kind") == "len"
    return cell.where(uni | length).groupBy(*by).agg(
        F.count_if(uni).alias("vocab"),
        F.count_if(length).alias("lengths"),
        F.coalesce(F.sum(F.when(uni, F.col("n"))), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.when(length, F.col("n"))), F.lit(0)).alias("lines"),
    )


def _width(vocab: Column, lengths: Column) -> Column:
    """The smoothing mass of a context: alpha times its outcomes and one unseen."""
    outcomes = F.when(F.col("kind") == "len", lengths).otherwise(F.greatest(F.lit(1), vocab))
    return ALPHA * (outcomes + 1)


def _by_model(parts: DataFrame, by: Sequence[str], models: Sequence[str]) -> DataFrame:
    """Log-likelihood by kind, rolled up into models."""
    uses = [
        F.when(F.col("kind").isin(*MODELS[m]), F.lit(m)) for m in models
    ]
    each = parts.withColumn("model", F.explode(F.filter(F.array(*uses), lambda m: m.isNotNull())))
    return each.groupBy(*by, "model").agg(F.sum("part").alias("ll"))


def transfer(
    train: DataFrame, test: DataFrame, by: Sequence[str], models: Sequence[str] = tuple(MODELS)
) -> DataFrame:
    """Log-likelihood of test cells, by the columns ``by``, under a model of the train cells.

    Returns ``by…, model, ll, lines, tokens``.
    """
    by = list(by)
    total = train.groupBy(*CELL).agg(F.sum("n").alias("total"))
    contexts = total.groupBy("kind", "ctx").agg(F.sum("total").alias("ctx_total"))
    size = _sizes(total.withColumnRenamed("total", "n"), []).select(
        F.struct("vocab", "lengths", "tokens").alias("s")
    )
    wanted = test.where(F.col("kind").isin(needed(models)))
    test_ctx = wanted.groupBy(*by, "kind", "ctx").agg(F.sum("n").alias("n"))
    test_ctx = test_ctx.join(contexts, ["kind", "ctx"], "left").withColumn("size", size.scalar())
    known = F.coalesce("ctx_total", F.lit(0))
    unseen = (F.col("kind") == "pos") & (known == 0)
    width = _width(F.col("size.vocab"), F.col("size.lengths"))
    # A position never seen in training falls back to the unigram counts.
    base = F.when(unseen, F.col("size.tokens")).otherwise(known)
    context_part = test_ctx.select(*by, "kind", (-F.col("n") * F.ln(base + width)).alias("part"))
    lost = test_ctx.where(unseen).select(*by, "kind", "ctx").withColumn("lost", F.lit(True))
    seen_cells = wanted.join(total, CELL, "left")
    if not lost.isEmpty():
        uni = total.where("kind = 'uni'").select("tok", F.col("total").alias("uni_total"))
        flagged = seen_cells.join(lost, [*by, "kind", "ctx"], "left")
        seen_cells = flagged.join(uni, ["tok"], "left").withColumn(
            "total", F.when(F.col("lost"), F.col("uni_total")).otherwise(F.col("total"))
        )
    count = F.coalesce("total", F.lit(0))
    cell_part = seen_cells.select(*by, "kind", (F.col("n") * F.ln(count + ALPHA)).alias("part"))
    ll = _by_model(context_part.unionByName(cell_part), by, models)
    sizes = _sizes(wanted, by).select(*by, "lines", "tokens")
    if not by:
        return ll.withColumn("_s", sizes.select(F.struct("lines", "tokens")).scalar()).select(
            "model", "ll", "_s.lines", "_s.tokens"
        )
    return ll.join(sizes, by, "left")


def leave_out(
    grouped: DataFrame, by: Sequence[str], models: Sequence[str] = tuple(MODELS)
) -> DataFrame:
    """Log-likelihood of each group under a model of all the other groups of its split.

    ``grouped`` has ``split`` and the group columns ``by`` next to the cells.
    Groups that leave no training line are dropped. Returns
    ``split, by…, model, ll, lines, tokens``.
    """
    by = ["split", *by]
    own = grouped.where(F.col("kind").isin(needed(models)))
    split_cell = ["split", *CELL]
    # Stored once with the totals of their cells: all that follows reads these rows and works no cell out again.
    # A cell has one row per group at most; an empty line has no first token, and so no such cell.
    total = F.when(F.col("tok").isNotNull(), F.sum("n").over(W.partitionBy(*split_cell)))
    joined = stored(own.withColumn("total", total))

    # What disappears from the vocabulary (and the lengths) with the group.
    only_here = F.col("n") == F.col("total")
    uni, length = F.col("kind") == "uni", F.col("kind") == "len"
    by_kind = joined.groupBy(*by, "kind").agg(
        F.sum("n").alias("n"),
        F.count_if(only_here).alias("lost"),
        F.sum(F.col("n") * F.ln(F.col("total") - F.col("n") + ALPHA)).alias("part"),
    )
    by_kind = cut(by_kind)  # one row per group and kind
    group = by_kind.groupBy(*by).agg(
        F.max(F.when(uni, F.col("lost"))).alias("lost_vocab"),
        F.max(F.when(length, F.col("lost"))).alias("lost_lengths"),
        F.max(F.when(uni, F.col("n"))).alias("tokens"),
        F.max(F.when(length, F.col("n"))).alias("lines"),
    )
    whole = joined.where(uni | length).groupBy(*split_cell).agg(F.sum("n").alias("n"))
    whole = _sizes(whole, ["split"])
    renamed = whole.select("split", *[F.col(c).alias(f"all_{c}") for c in ("vocab", "lengths", "tokens", "lines")])
    group = cut(
        group.join(renamed, ["split"], "left")
        .where(F.col("lines") < F.col("all_lines"))
        .withColumns(
            {
                "vocab": F.col("all_vocab") - F.col("lost_vocab"),
                "lengths": F.col("all_lengths") - F.col("lost_lengths"),
                "rest_tokens": F.col("all_tokens") - F.col("tokens"),
            }
        )
        .select(*by, "vocab", "lengths", "rest_tokens", "tokens", "lines")
    )

    # A line has a token at every position of its length, so the positions of a length have the counts of the length.
    times = F.col("tok").cast("long")
    positions = joined.where(length).select(*by, F.lit("pos").alias("kind"), times.alias("times"), "n", F.col("total").alias("ctx_total"))
    other = joined.where("kind <> 'pos'").groupBy(*by, "kind", "ctx").agg(F.sum("n").alias("n"))
    other = other.withColumn("ctx_total", F.sum("n").over(W.partitionBy("split", "kind", "ctx")))
    ctx = other.select(*by, "kind", F.lit(1).cast("long").alias("times"), "n", "ctx_total")
    if "pos" in needed(models):
        ctx = ctx.unionByName(positions)
    ctx = ctx.join(group.select(*by, "vocab", "lengths", "rest_tokens"), by, "inner")
    rest = F.col("ctx_total") - F.col("n")
    unseen = (F.col("kind") == "pos") & (rest == 0)
    width = _width(F.col("vocab"), F.col("lengths"))
    # All cells of an unseen position are this group's alone; take their ln(alpha) back.
    swapped = -F.lit(1.0) * F.col("n") * (F.ln(F.lit(ALPHA)) + F.ln(F.col("rest_tokens") + width))
    plain = -F.lit(1.0) * F.col("n") * F.ln(rest + width)
    context_part = ctx.select(*by, "kind", (F.col("times") * F.when(unseen, swapped).otherwise(plain)).alias("part"))
    parts = by_kind.select(*by, "kind", "part").unionByName(context_part)

    if "position" in models:
        # A length is lost with one group of a split at most, so these are no more rows than there are lengths.
        lost = joined.where(length & only_here).select(*by, F.col("tok").alias("_length"))
        lengthy = joined.where("kind = 'pos'").withColumn("_length", F.substring_index("ctx", ":", 1))
        orphans = lengthy.join(F.broadcast(lost), [*by, "_length"], "left_semi").groupBy(*by, "tok").agg(F.sum("n").alias("m"))
        uni_rest = joined.where(uni).select(*by, "tok", (F.col("total") - F.col("n")).alias("rest"))
        # One row per group and token on both sides.
        fallback = orphans.join(uni_rest, [*by, "tok"]).select(
            *by, F.lit("pos").alias("kind"), (F.col("m") * F.ln(F.col("rest") + ALPHA)).alias("part")
        )
        parts = parts.unionByName(fallback)
    ll = _by_model(parts, by, models)
    return ll.join(group.select(*by, "lines", "tokens"), by, "inner")


def cross_groups(
    grouped: DataFrame, by: str, models: Sequence[str] = tuple(MODELS)
) -> DataFrame:
    """Train on one group, score all the others together; one row per training group and model.

    The sums over cells and contexts that a group lacks are closed forms of
    the totals, so groups are never paired with foreign cells.
    Returns ``by, model, ll, lines, tokens``.
    """
    own = cut(grouped.where(F.col("kind").isin(needed(models))))
    total = own.groupBy(*CELL).agg(F.sum("n").alias("total"))
    contexts = total.groupBy("kind", "ctx").agg(F.sum("total").alias("ctx_total"))
    kinds = contexts.groupBy("kind").agg(F.sum("ctx_total").alias("kind_total"))
    whole = _sizes(total.withColumnRenamed("total", "n"), []).select(
        F.struct("lines", "tokens").alias("s")
    )
    group = _sizes(own, [by]).withColumn("whole", whole.scalar())
    group = cut(group.where(F.col("lines") < F.col("whole.lines")))
    # Unseen everywhere: every foreign occurrence at ln(alpha) over an empty context.
    per_kind = group.withColumn("kind", F.explode(F.array(*map(F.lit, needed(models)))))
    per_kind = per_kind.join(F.broadcast(kinds), "kind")
    width = _width(F.col("vocab"), F.col("lengths"))
    start = per_kind.select(
        by, "kind", (F.col("kind_total") * (F.ln(F.lit(ALPHA)) - F.ln(width))).alias("part")
    )
    joined = own.join(total, CELL, "left")
    log_alpha = F.ln(F.lit(ALPHA))
    cell_part = joined.select(
        by,
        "kind",
        (
            (F.col("total") - F.col("n")) * F.ln(F.col("n") + ALPHA) - F.col("total") * log_alpha
        ).alias("part"),
    )
    ctx = own.groupBy(by, "kind", "ctx").agg(F.sum("n").alias("n"))
    ctx = ctx.join(contexts, ["kind", "ctx"], "left").join(group.select(by, "vocab", "lengths", F.col("tokens").alias("own_tokens")), [by], "inner")
    context_part = ctx.select(
        by,
        "kind",
        (
            F.col("ctx_total") * F.ln(width)
            - (F.col("ctx_total") - F.col("n")) * F.ln(F.col("n") + width)
        ).alias("part"),
    )
    parts = start.unionByName(cell_part).unionByName(context_part)
    if "position" in models:
        parts = parts.unionByName(_position_fallback(own, total, ctx, group, kinds, by))
    ll = _by_model(parts, [by], models)
    rest = group.select(
        by,
        (F.col("whole.lines") - F.col("lines")).alias("lines"),
        (F.col("whole.tokens") - F.col("tokens")).alias("tokens"),
    )
    return ll.join(rest, [by], "inner")


def _position_fallback(
    own: DataFrame, total: DataFrame, ctx: DataFrame, group: DataFrame, kinds: DataFrame, by: str
) -> DataFrame:
    """Foreign tokens at positions that a group never saw are scored by its unigram counts.

    A line of some length has a token at every position of that length, so a
    group has seen all positions of its lengths and none of others. For each of
    its tokens, what is left over is the total less the occurrences in lines of
    its lengths, or the occurrences in lines of the others, whichever lengths
    are fewer; a group's tokens meet the counts of (length, token) only.
    """
    seen = ctx.where("kind = 'pos'")
    lost_total = seen.groupBy(by).agg(F.sum("ctx_total").alias("seen_total"))
    pos_total = kinds.where("kind = 'pos'").select("kind_total")
    width = _width(F.col("vocab"), F.col("lengths"))
    kind = F.lit("pos").alias("kind")
    left = group.join(lost_total, by).withColumn("kind", F.lit("pos")).withColumn("pos_total", pos_total.scalar())
    missing = F.col("pos_total") - F.col("seen_total")
    # Replace ln(alpha) - ln(width) of the missing tokens: first take it back, then the context
    # becomes the unigram one; tokens that the group lacks keep ln(alpha).
    base = left.select(
        by, kind, (missing * (F.ln(width) - F.ln(F.col("tokens") + width))).alias("part")
    )
    mine, met = _tokens_by_length(own, total, by)
    # Inside its lengths a token is counted off its total, outside it is counted itself.
    sign = F.when(F.col("_inside"), -1).otherwise(1)
    counted = met.select(by, kind, (sign * F.col("there") * F.col("gain")).alias("part"))
    all_uni = total.where("kind = 'uni'").select("tok", F.col("total").alias("uni_total"))
    totals = mine.where("_inside").join(all_uni, "tok").select(by, kind, (F.col("uni_total") * F.col("gain")).alias("part"))
    return base.unionByName(counted).unionByName(totals)


def _tokens_by_length(own: DataFrame, total: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """Each group's tokens, and those met with the corpus counts of the fewer of (its lengths, other lengths)."""
    all_lengths = total.where("kind = 'len'").agg(F.array_sort(F.collect_set("tok"))).scalar()
    lengths = own.where("kind = 'len'").groupBy(by).agg(F.collect_set("tok").alias("_own")).withColumn("_all", all_lengths)
    fewer = F.size("_own") * 2 <= F.size("_all")
    chosen = lengths.select(
        by, fewer.alias("_inside"), F.when(fewer, F.col("_own")).otherwise(F.array_except("_all", "_own")).alias("_lengths")
    )
    mine = own.where("kind = 'uni'").select(by, "tok", F.col("n").alias("own_n"))
    gain = F.ln(F.col("own_n") + ALPHA) - F.ln(F.lit(ALPHA))
    mine = mine.select(by, "tok", gain.alias("gain")).join(chosen, by)
    by_length = (
        total.where("kind = 'pos'")
        .groupBy(F.substring_index("ctx", ":", 1).alias("length"), "tok")
        .agg(F.sum("total").alias("there"))
    )
    met = mine.select(by, "tok", "gain", "_inside", F.explode("_lengths").alias("length")).join(by_length, ["length", "tok"])
    return mine, met
