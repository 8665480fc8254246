"""A Merkle manifest of documents, and a recursive query that climbs it with a proof for every leaf.

The digest of a row is a leaf. Inside each group (language) the leaves ascend by
id, and every ``FAN`` consecutive nodes become a node of the next level until one
is left, the group's subroot. The subroots, in the order of their groups,
become the root in the same way. Every level is one grouping of its nodes, and
the built nodes are kept as rows that name their parent:

``node, parent, left, right`` (the digests of the siblings before and after).

A recursive query of Spark then ascends from the leaves: a step joins the node
that was reached to its row, folds the carried digests with the siblings of
that row and appends those siblings to the proof. The leaves of one run share
all siblings above the first level, so a run of at most ``FAN`` leaves climbs as
one row that holds a folded digest for each leaf. The query runs over written
rows and its result is written, so lost executors cost only their tasks.

Leaf order inside a group is (id, digest), NULL ids first; rows that are equal
in both are interchangeable. NULL and empty values differ (``-`` and ``0:``).
Very long texts are only hashed. A table without rows gives no rows. Further
columns, of whatever name, are not read. A group may hold any share of the
rows: ordering and numbering go by range partitions, and runs have ``FAN`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linegrain.llm.common import pinned
from linegrain.scale import ordered_index

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def framed(value: Column) -> Column:
    """``-`` for NULL, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*[framed(f) for f in fields]), 256)


def leaves(docs: DataFrame, group: str = "lang", fields: Sequence[str] = FIELDS, text: str = "text") -> DataFrame:
    """(grp, doc_id, leaf, shown): digests of the rows, and of the rows as tampered with.

    Tampering lower-cases A to Z in the text of every row whose id has a
    CRC-32 that 3 divides; elsewhere ``shown`` is the leaf.
    """
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    changed = [F.translate(F.col(f), UPPER, LOWER) if f == text else F.col(f) for f in fields]
    leaf = row_digest(*[F.col(f) for f in fields])
    return docs.select(
        F.col(group).cast("string").alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("leaf"),
        F.when(tampered, row_digest(*changed)).otherwise(leaf).alias("shown"),
    )


def _numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves with the number of their tree and their place in it, and the trees with their sizes."""
    ordered = pinned(ordered_index(rows, ["grp", "doc_id", "leaf", "shown"], "_at"), "manifest-leaves")
    groups = ordered.groupBy("grp").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("size"))
    # The first place of a tree orders the trees as their groups are ordered: NULL first, then bytewise.
    trees = pinned(ordered_index(groups, ["_first"], "tree"), "manifest-trees").withColumn("tree", F.col("tree") - 1)
    named = trees.select(F.col("grp").alias("_grp"), "_first", "size", "tree")
    placed = ordered.join(named, F.col("grp").eqNullSafe(F.col("_grp"))).select(
        "tree", "size", (F.col("_at") - F.col("_first")).alias("pos"), "doc_id", "leaf", "shown"
    )
    return placed, trees


def node_id(tree: Column | str, level: int, pos: Column) -> Column:
    return F.concat_ws(":", tree, F.lit(level), pos)


def _runs(nodes: DataFrame) -> DataFrame:
    """The nodes of trees that still have several, gathered in runs of ``FAN``."""
    run = F.floor(F.col("pos") / FAN).cast("long")
    member = F.struct("pos", "digest")
    return (
        nodes.where("size > 1")
        .groupBy("tree", "size", run.alias("run"))
        .agg(F.array_sort(F.collect_list(member)).alias("members"))
    )


def _joined(members: Column, first: Column | int, count: Column) -> Column:
    return F.array_join(F.transform(F.slice(members, first, count), lambda m: m["digest"]), "")


def _linked(runs: DataFrame, level: int) -> DataFrame:
    """A row for each member of the runs: itself, its parent and its siblings' digests."""
    each = runs.select("tree", "run", "members", F.posexplode("members").alias("i", "m"))
    return each.select(
        node_id("tree", level, F.col("m.pos")).alias("node"),
        node_id("tree", level + 1, F.col("run")).alias("parent"),
        _joined(F.col("members"), 1, F.col("i")).alias("left"),
        _joined(F.col("members"), F.col("i") + 2, F.size("members") - F.col("i") - 1).alias("right"),
    )


def _above(runs: DataFrame) -> DataFrame:
    digest = F.sha2(F.array_join(F.transform("members", lambda m: m["digest"]), ""), 256)
    return runs.select("tree", F.ceil(F.col("size") / FAN).cast("long").alias("size"), F.col("run").alias("pos"), digest.alias("digest"))


def _grow(nodes: DataFrame, level: int, most: int, parts: list[DataFrame]) -> DataFrame:
    """All levels above ``nodes``; returns the last node of each tree with its id in ``node``."""
    tops = None
    while True:
        top = nodes.where("size = 1").select("tree", node_id("tree", level, F.col("pos")).alias("node"), "digest")
        tops = top if tops is None else tops.unionByName(top)
        if most <= 1:
            return tops
        runs = _runs(nodes)
        parts.append(_linked(runs, level))
        nodes = pinned(_above(runs), "manifest-level")
        level, most = level + 1, -(-most // FAN)


@contextmanager
def _unlimited_recursion(spark: SparkSession):
    """Spark ends a recursive query at a million rows unless told otherwise; depth needs no more than its 100."""
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


#: Digests are carried as bytes, and what a run need not carry is joined again at the end.
CLIMB = """
WITH RECURSIVE climb (node, start, folded, proof) AS (
  SELECT node, node, folded, CAST('' AS BINARY) FROM {base}
  UNION ALL
  SELECT n.parent, c.start,
    transform(c.folded, x -> unhex(sha2(concat(n.left, lower(hex(x)), n.right), 256))),
    concat(c.proof, unhex(concat(n.left, n.right)))
  FROM climb c JOIN {nodes} n ON c.node = n.node)
SELECT start, folded, proof FROM climb WHERE node = {top}"""


def verify(docs: DataFrame, group: str = "lang", fields: Sequence[str] = FIELDS, text: str = "text") -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row."""
    spark = docs.sparkSession
    digested = pinned(leaves(docs, group, fields, text), "manifest-digests")
    placed, trees = _numbered(digested)
    most, n_trees = trees.agg(F.max("size"), F.count(F.lit(1))).first()
    if not n_trees:
        return spark.createDataFrame([], RESULT)

    # The leaf level: a run keeps its leaves, with what each has beside it.
    row = F.struct("pos", F.col("leaf").alias("digest"), "doc_id", "shown")
    runs = placed.groupBy("tree", "size", F.floor(F.col("pos") / FAN).cast("long").alias("run")).agg(
        F.array_sort(F.collect_list(row), lambda a, b: (a["pos"] - b["pos"]).cast("int")).alias("members")
    )
    runs = pinned(runs, "manifest-runs")
    parts: list[DataFrame] = []
    single = runs.where("size = 1")
    alone = single.select("tree", F.lit(1).cast("long").alias("size"), F.col("run").alias("pos"), F.col("members")[0]["digest"].alias("digest"))
    above = pinned(_above(runs.where("size > 1")), "manifest-level")
    lone_tops = alone.select("tree", node_id("tree", 0, F.col("pos")).alias("node"), "digest")
    tops = pinned(_grow(above, 1, -(-most // FAN), parts).unionByName(lone_tops), "manifest-subroots")

    # The tree of subroots: its leaves are the nodes at the top of the other trees.
    crown = F.lit(-1).cast("long")
    crowned = tops.select(crown.alias("tree"), F.lit(n_trees).cast("long").alias("size"), F.col("tree").alias("pos"), "digest")
    final = _grow(crowned, 0, n_trees, parts).first()
    linked = tops.select(node_id(crown, 0, F.col("tree")).alias("_as"), F.col("node").alias("_node"))
    nodes = None
    for part in parts:
        nodes = part if nodes is None else nodes.unionByName(part)
    if nodes is None:  # one row in all
        nodes = tops.select("node", F.col("node").alias("parent"), F.lit("").alias("left"), F.lit("").alias("right")).limit(0)
    nodes = nodes.join(linked, F.col("node") == F.col("_as"), "left")
    nodes = pinned(nodes.select(F.coalesce("_node", "node").alias("node"), "parent", "left", "right"), "manifest-nodes")
    top = final["node"] if n_trees > 1 else tops.first()["node"]

    many = F.col("size") > 1

    def beside(i: Column) -> tuple[Column, Column]:
        return _joined(F.col("members"), F.lit(1), i), _joined(F.col("members"), i + 2, F.size("members") - i - 1)

    def started(m: Column, i: Column) -> Column:
        before, after = beside(i)
        return F.unhex(F.when(many, F.sha2(F.concat(before, m["shown"], after), 256)).otherwise(m["shown"]))

    begun = runs.withColumn("node", F.concat_ws(":", "tree", F.when(many, F.lit(1)).otherwise(F.lit(0)), "run"))
    base = begun.select("node", F.transform("members", started).alias("folded"))
    with _unlimited_recursion(spark):
        climbed = pinned(spark.sql(CLIMB, base=base, nodes=nodes, top=top), "manifest-climb")
    subroots = tops.select("tree", F.col("digest").alias("subroot"))
    met = begun.join(climbed, F.col("node") == F.col("start")).join(subroots, "tree")

    def told(m: Column, i: Column) -> Column:
        near = F.when(many, F.concat(*beside(i))).otherwise("")
        folded = F.lower(F.hex(F.get("folded", i)))
        return F.struct(m["doc_id"].alias("doc_id"), m["digest"].alias("leaf"), near.alias("near"), folded.alias("folded"))

    proof = F.lower(F.hex("proof")).alias("proof")
    each = met.select("subroot", proof, F.explode(F.transform("members", told)).alias("x"))
    root = F.lit(final["digest"])
    return each.select(
        "x.doc_id", "x.leaf", "subroot", root.alias("root"), F.sha2(F.concat("x.near", "proof"), 256).alias("proof_sha256"),
        F.col("x.folded").alias("folded_root"), (F.col("x.folded") == root).alias("verified"),
    )
