"""Building blocks that keep hot groups from landing in one task.

Every helper here is exact: the rows that come out do not depend on how many
rows share a key, only the physical route does.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linegrain.session import cut, stored

# Rows of one group that a single task may sort or hold.
GROUP_LIMIT = 200_000
# Buckets that groups are counted in before any of them is counted alone.
SIZE_BUCKETS = 1 << 16
# Values in one list cell.
PAGE = 1_000

_PARTITION_SHIFT = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def ordered_index(
    df: DataFrame, order: Sequence[Column | str], name: str = "idx",
    store: Callable[[DataFrame], DataFrame] = cut, unkept: Sequence[str] = (),
) -> DataFrame:
    """Number rows 1, 2, 3, … by ``order`` (a total order) without a global window.

    ``unkept`` columns serve the order only and are not stored.

    Rows are range-partitioned and sorted, each partition numbers its own rows,
    and the partition sizes (one row per partition) give the offsets. The
    checkpoint pins the partitioning, so that the sizes and the rows agree even
    after an executor is lost.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    pinned = store(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_row", F.monotonically_increasing_id())
        .drop(*unkept)
    ).withColumn("_part", F.shiftright("_row", _PARTITION_SHIFT))
    sizes = pinned.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    within = F.col("_row").bitwiseAND(F.lit((1 << _PARTITION_SHIFT) - 1))
    return (
        pinned.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_offset") + within + 1).cast("long"))
        .drop("_part", "_row", "_offset")
    )


def ordered_cumsum(
    df: DataFrame, order: Sequence[Column | str], value: str, name: str = "before"
) -> DataFrame:
    """The sum of ``value`` over all earlier rows of a total order, without a global window.

    As in :func:`ordered_index`, only one row per partition is summed centrally;
    the running sum inside a range partition stays in its task.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    pinned = cut(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_row", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_row", _PARTITION_SHIFT))
    sums = pinned.groupBy("_part").agg(F.sum(value).alias("_sum"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset")
    )
    inside = W.partitionBy("_part").orderBy("_row").rowsBetween(W.unboundedPreceding, -1)
    running = F.coalesce(F.sum(value).over(inside), F.lit(0))
    return (
        pinned.withColumn("_run", running)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_offset") + F.col("_run")).cast("long"))
        .drop("_part", "_row", "_offset", "_run")
    )


def group_rank(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    name: str = "rank",
    limit: int = GROUP_LIMIT,
    near: Sequence[str] = (),
) -> DataFrame:
    """Rank rows 1, 2, 3, … inside each group; ``order`` must be total within a group.

    Groups up to ``limit`` rows use a window. Larger ones are numbered by
    :func:`ordered_index` over the whole set of large groups and shifted by
    their group's first number, so that no task sorts a large group alone.
    Where all groups are small, rows lie by the columns ``near`` of the group, if any are named.
    """
    small = W.partitionBy(*group).orderBy(*order)
    # A large group fills its bucket: the buckets are counted map-side, and groups are only where one is full.
    bucket = F.pmod(F.xxhash64(*group), F.lit(SIZE_BUCKETS))
    full = df.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    # At most rows / limit of them.
    full = [r["_bucket"] for r in full.collect()]
    sizes = df.where(bucket.isin(full)).groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    hot = sizes.where(F.col("_n") > limit)
    if not full or hot.isEmpty():
        dealt = df.repartition(*near) if near else df
        return dealt.withColumn(name, F.row_number().over(small).cast("long"))
    flagged = _join_groups(df, hot.select(*group, F.lit(True).alias("_hot")), group)
    cold = flagged.where(F.col("_hot").isNull()).drop("_hot")
    cold = cold.withColumn(name, F.row_number().over(small).cast("long"))
    large = ordered_index(
        flagged.where(F.col("_hot").isNotNull()).drop("_hot"), [*group, *order], "_at"
    )
    # One row per hot group: at most (rows / limit) of them.
    starts = large.groupBy(*group).agg(F.min("_at").alias("_first"))
    ranked = _join_groups(large, starts, group).withColumn(
        name, F.col("_at") - F.col("_first") + 1
    )
    return cold.unionByName(ranked.drop("_at", "_first"))


def _join_groups(df: DataFrame, per_group: DataFrame, group: Sequence[str]) -> DataFrame:
    """Left join on group columns that may be NULL."""
    renamed = per_group.withColumnsRenamed({g: f"_g_{g}" for g in group})
    same = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group]
    return df.join(renamed, same, "left").drop(*[f"_g_{g}" for g in group])


def carry_forward(df: DataFrame, order: Sequence[Column | str], value: str, name: str) -> DataFrame:
    """The last non-NULL ``value`` at or before each row of a total order.

    An as-of join is this over the union of both sides. Rows are sorted into
    ranges; each range looks back inside itself, and its first rows take what
    the ranges before it ended with, one row per range.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    pinned = cut(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_row", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_row", _PARTITION_SHIFT))
    ends = pinned.groupBy("_part").agg(
        F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.col("_row"))).alias("_end")
    )
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select("_part", F.last("_end", True).over(before).alias("_carried"))
    inside = W.partitionBy("_part").orderBy("_row").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        pinned.withColumn("_last", F.last(value, True).over(inside))
        .join(F.broadcast(carried), "_part")
        .withColumn(name, F.coalesce("_last", "_carried"))
        .drop("_part", "_row", "_last", "_carried")
    )


def list_pages(
    df: DataFrame, group: Sequence[str], value: str, separator: Column | str = ",", page: int = PAGE, near: Sequence[str] = ()
) -> DataFrame:
    """Sorted distinct ``value`` s of each group as joined text, ``page`` values a row.

    A group with few values gives one row (page 0); a group with very many
    gives several, so that the list is whole and no cell is unbounded. ``separator`` may
    depend on the columns of the group. What leads to ``df`` runs once: the
    distinct values are stored before their groups are sized and ranked. The pages
    lie by ``near`` if no group is large, ready for a join.
    """
    distinct = stored(df.select(*group, value).where(F.col(value).isNotNull()).distinct())
    between = F.lit(separator) if isinstance(separator, str) else separator
    ranked = group_rank(distinct, group, [value], "_rank", near=near)
    paged = ranked.withColumn("page", F.floor((F.col("_rank") - 1) / page).cast("int"))
    return paged.groupBy(*group, "page").agg(
        F.call_function("array_join", F.array_sort(F.collect_list(value)), between).alias("items"),
        F.count(F.lit(1)).alias("item_count"),
    )


def whole_lists(lists: DataFrame, group: Sequence[str], separator: str = ",") -> DataFrame:
    """The pages of :func:`list_pages` put together again: one ``items`` for each group."""
    pages = F.array_sort(F.collect_list(F.struct("page", "items")))
    return lists.groupBy(*group).agg(F.array_join(F.transform(pages, lambda p: p["items"]), separator).alias("items"))
