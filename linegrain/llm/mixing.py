"""Mixing sources to target weights.

Sources get weights by turns and share all words in proportion to them; no
source's target passes ``cap`` times its own size, and what it cannot take is
shared again by weight among the others until none is above.

Inside a source, every document gets a hash-random key. One range sort by
(source, key) orders all sources at once, prefix sums of the words run through
its partitions, and each source is cut exactly where its budget ends: whole
epochs first, then the documents in front of the cut once more, and of the
document at the cut only its first words.

A NULL source is a source of its own and comes last. NULL or empty texts have
size 0, take 0 words, and are no part of the mixed documents. Equal rows are
told apart only by place, which makes no difference to the result as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linegrain.llm.common import WORD, n_words, pinned
from linegrain.scale import ordered_cumsum, ordered_index

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"


def targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, weight, target) from rows of (source, size).

    The loop repeats the sharing, one small aggregate over sources a turn; each
    turn holds back at least one more source, and usually all of them at once.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = ordered_index(sizes, [F.col("source").isNull(), F.col("source")], "_no")
    turn = F.array(*[F.lit(w) for w in weights])
    weighed = pinned(
        numbered.select(
            "source",
            "source_size",
            F.element_at(turn, (F.pmod(F.col("_no") - 1, F.lit(len(weights))) + 1).cast("int")).alias("weight"),
            (F.col("source_size") * cap).alias("_most"),
        ),
        "mix-sources",
    )
    level, held_before = float("-inf"), -1
    while True:
        full = F.col("_most") <= F.lit(level) * F.col("weight")
        row = weighed.agg(
            F.sum("source_size").alias("all"),
            F.count_if(full).alias("held"),
            F.sum(F.when(full, F.col("_most"))).alias("taken"),
            F.sum(F.when(~full, F.col("weight"))).alias("weight"),
        ).first()
        if row["held"] == held_before or not row["weight"]:
            break
        held_before = row["held"]
        level = float(row["all"] - (row["taken"] or 0)) / float(row["weight"])
    target = F.least(F.col("_most").cast("double"), F.lit(level) * F.col("weight"))
    return weighed.select("source", "source_size", "weight", target.alias("target"))


def taken(sized: DataFrame, shares: DataFrame, order: Sequence[str], seed: str = SEED) -> DataFrame:
    """Adds source_size, target and ``taken`` to rows of (source, size, …).

    ``order`` names the columns behind the random key; the first one is hashed.
    """
    key = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(order[0]).cast("string"))), 1, 16)
    keyed = sized.withColumn("_key", key).withColumn("_none", F.col("source").isNull())
    run = ordered_cumsum(keyed, ["_none", "source", "_key", *order], "size", "_before")
    ends = ordered_cumsum(
        shares.withColumn("_none", F.col("source").isNull()), ["_none", "source"], "source_size", "_first"
    ).select(F.col("source").alias("_source"), "source_size", "target", "_first")
    joined = run.join(ends, F.col("source").eqNullSafe(F.col("_source")))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(0)
    left = budget - F.col("_epochs") * F.col("source_size") - (F.col("_before") - F.col("_first"))
    return (
        joined.withColumn("_epochs", epochs)
        .withColumn("_part", F.greatest(F.lit(0), F.least(F.col("size"), left)))
        .withColumn("taken", F.col("_epochs") * F.col("size") + F.col("_part"))
        .drop("_key", "_none", "_source", "_before", "_first")
    )


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) per document."""
    sized = pinned(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(text).alias("size")),
        "mix-sizes",
    )
    plan = taken(sized, targets(sized), ["doc_id", "size"])
    return plan.select("doc_id", "source", "size", "source_size", "target", "taken")


def _first_words(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import re

    pattern = re.compile(WORD)
    for part in parts:
        cut = []
        for text, k in zip(part["_text"], part["_part"], strict=True):
            end = 0
            for i, found in enumerate(pattern.finditer(text)):
                if i == k:
                    break
                end = found.end()
            cut.append(text[:end])
        yield part.assign(_text=cut)


def mixed_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """The mixed corpus: rows of ``docs``, once for every epoch that takes them.

    The document in which a budget ends gives its first words. Columns that
    describe the text's length are the caller's to renew.
    """
    spark_row = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    rows = pinned(
        docs.select(
            F.monotonically_increasing_id().alias("_rid"),
            F.col(doc_id).alias("_doc"),
            F.col(source).alias("source"),
            n_words(text).alias("size"),
            spark_row,
        ),
        "mix-rows",
    )
    slim = rows.select("_rid", "_doc", "source", "size")
    plan = taken(slim, targets(slim), ["_doc", "size", "_rid"]).where("taken > 0")
    joined = rows.select("_rid", "_row").join(plan.select("_rid", "size", "_epochs", "_part"), "_rid")
    whole = joined.select(
        "_row", (F.col("_epochs") + (F.col("_part") == F.col("size")).cast("int")).alias("_times")
    )
    whole = whole.where("_times > 0").withColumn(
        "_i", F.explode(F.array_repeat(F.lit(0), F.col("_times").cast("int")))
    )
    whole = whole.select("_row.*")
    ends = joined.where("_part > 0 and _part < size").select("_row", "_part", F.col(f"_row.{text}").alias("_text"))
    cut = ends.mapInPandas(_first_words, ends.schema).select(
        *[F.col("_text").alias(c) if c == text else F.col(f"_row.{c}").alias(c) for c in docs.columns]
    )
    return whole.unionByName(cut)
