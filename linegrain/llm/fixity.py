"""Merkle fixity audit of two replicas of a record store.

Records of a shard lie at offsets. A leaf is the hash of the records at one
offset; a node of level k covers FANOUT ** k neighbouring offsets and hashes
its children in order, up to one root per shard. Two replicas compare roots,
and only below nodes that differ are the next level's nodes compared, down to
the offsets that are changed, missing or extra. Levels are written tables.

NULL shards are a shard; rows with a NULL offset are held at offset -1; NULL
payloads differ from empty ones; several records at an offset are one leaf, in
the order of their hashes. Offsets are 0 or more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linegrain.llm.common import pinned

FANOUT_BITS = 4


def _joined(children: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("child", "hash")))
    text = F.array_join(F.transform(ordered, lambda x: F.concat_ws("=", x["child"].cast("string"), x["hash"])), ",")
    return children.groupBy("shard", "node").agg(F.sha2(text, 256).alias("hash"))


def leaves(records: DataFrame, shard: str, offset: str, payload: str) -> DataFrame:
    """(shard, node, hash): equal records at an offset are counted first, so that no list is long for copies."""
    own = F.coalesce(F.sha2(F.col(payload).cast("binary"), 256), F.lit("null"))
    rows = records.select(F.to_json(F.struct(F.col(shard).alias("s"))).alias("shard"),
                          F.coalesce(F.col(offset), F.lit(-1)).cast("long").alias("node"), own.alias("hash"))
    counted = rows.groupBy("shard", "node", "hash").agg(F.count(F.lit(1)).alias("child"))
    return _joined(counted)


def tree(records: DataFrame, levels: int, shard: str, offset: str, payload: str) -> list[DataFrame]:
    """Written levels from the leaves to the roots."""
    out = [pinned(leaves(records, shard, offset, payload), "fixity-0")]
    for k in range(1, levels + 1):
        parents = out[-1].select("shard", F.shiftright("node", FANOUT_BITS).alias("node"), F.col("node").alias("child"), "hash")
        out.append(pinned(_joined(parents), f"fixity-{k}"))
    return out


def audit(one: DataFrame, two: DataFrame, shard: str, offset: str, payload: str) -> DataFrame:
    """(shard as JSON, offset, state) of every offset at which the replicas differ."""
    most = one.select(offset).unionByName(two.select(offset)).agg(F.max(offset)).first()[0] or 0
    levels = -(-max(1, int(most).bit_length()) // FANOUT_BITS)
    first, second = (tree(x, levels, shard, offset, payload) for x in (one, two))
    above = None
    for k in range(levels, -1, -1):
        sides = []
        for side, level in (("a", first[k]), ("b", second[k])):
            if above is not None:  # only below what differs
                level = level.withColumn("up", F.shiftright("node", FANOUT_BITS)).join(above, ["shard", "up"], "left_semi")
            sides.append(level.select("shard", "node", F.col("hash").alias(side)))
        differs = sides[0].join(sides[1], ["shard", "node"], "full").where(~F.col("a").eqNullSafe(F.col("b")))
        if k:
            above = pinned(differs.select("shard", F.col("node").alias("up")), "fixity-differs")
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("changed")
    return differs.select("shard", F.col("node").alias("offset"), state.alias("state"))
