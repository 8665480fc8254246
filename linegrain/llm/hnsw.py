"""Approximate nearest neighbours: a navigable small-world graph per shard.

Equal vectors are one node, with the smallest ids of its rows as its members;
more ids, or more rows of an id, than a query can return are never needed. Nodes are dealt into
shards by hash. A shard's graph is built in one task, layer by layer from the
top: every node has a level drawn from its hash, and nodes enter in rounds of
growing size, each round searching the graph so far for all its nodes at once.
Neighbour lists are flat arrays: one matrix of node numbers per layer, -1 for
none. The finished arrays are written as one row per shard.

Search hands all query vectors to every shard. A task loads a shard's arrays
once, takes the queries batch by batch, walks down the layers for a whole
batch together, and returns each query's best nodes of the shard; Spark merges
the shards' lists.

Nearness is the inner product. Vectors get one more coordinate that makes all
of a shard's equally long, so that the largest inner product is the smallest
distance. Results are scored anew on the original vectors in double precision.

Vectors that are NULL, zero, or hold NULL, NaN or infinite components take no
part, neither as queries nor as candidates. Vectors of another dimension than
most rows of the table have take no part either. Rows with NULL or equal ids
are candidates of their own; a query never returns rows of its own id. An id
with several rows is one query: each other row counts once, by its best score.
Own rows are left out before anything is cut to ``k``: an id with several
vectors takes a shard's nodes without those that only it has, and where those
are many, the shard's nodes are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linegrain.llm.common import pinned

#: Nodes of a shard, neighbours of a node (twice as many on the ground layer), width of searches.
SHARD, DEGREE, BUILD_WIDTH, SEARCH_WIDTH = 8_192, 16, 64, 96
#: Queries that walk together.
TOGETHER = 512


class Graph:
    """Flat neighbour arrays over the rows of a matrix."""

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, width: int = BUILD_WIDTH, seed: int = 0):
        self.x = vectors.astype(np.float32)
        self.square = np.einsum("ij,ij->i", self.x, self.x)
        n = len(self.x)
        draw = np.random.default_rng([seed, n]).random(n)
        self.level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(degree)).astype(int), 8)
        self.order = np.argsort(-self.level, kind="stable")
        self.layers = [
            np.full((n, degree * (2 if i == 0 else 1)), -1, np.int32) for i in range(int(self.level.max(initial=0)) + 1)
        ]
        self.entry = int(self.order[0]) if n else -1
        if n:
            self._build(width)

    def _build(self, width: int) -> None:
        done = 1
        while done < len(self.order):
            fresh = self.order[done : done + max(1, min(done, TOGETHER))]
            # a round's nodes see those before it; among themselves they meet as candidates of each other
            start = np.full((len(fresh), 1), self.entry, np.int32)
            for layer in range(len(self.layers) - 1, -1, -1):
                member = self.level[fresh] >= layer
                found, away = self.walk(self.x[fresh], start, layer, width if member.any() else 1)
                if member.any():
                    self._join(fresh[member], found[member], away[member], layer)
                start = found[:, : max(1, min(8, found.shape[1]))]
            done += len(fresh)

    def _join(self, nodes: np.ndarray, found: np.ndarray, away: np.ndarray, layer: int) -> None:
        table = self.layers[layer]
        own = self.x[nodes]
        among = self.square[nodes][None, :] - 2 * own @ own.T + self.square[nodes][:, None]
        np.fill_diagonal(among, np.inf)
        k = min(len(nodes) - 1, table.shape[1])
        if k > 0:
            near = np.argpartition(among, k - 1, axis=1)[:, :k]
            found = np.concatenate([found, nodes[near].astype(np.int32)], axis=1)
            away = np.concatenate([away, np.take_along_axis(among, near, 1)], axis=1)
        picked = self._spread(found, away, table.shape[1])
        table[nodes] = picked
        # links back: new neighbours beside the old ones, then the spread choice again
        source, target = np.repeat(nodes, picked.shape[1]), picked.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        hit, begin, count = np.unique(target, return_index=True, return_counts=True)
        most = int(count.max(initial=0))
        added = np.full((len(hit), most), -1, np.int32)
        place = np.arange(len(target)) - np.repeat(begin, count)
        added[np.repeat(np.arange(len(hit)), count), place] = source
        both = np.concatenate([table[hit], added], axis=1)
        away = self._from(self.x[hit], self.square[hit], both)
        table[hit] = self._spread(both, away, table.shape[1])

    def _from(self, q: np.ndarray, q_square: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distances of each row's nodes; infinite for none."""
        dots = np.einsum("bd,bkd->bk", q, self.x[np.maximum(nodes, 0)], optimize=True)
        return np.where(nodes >= 0, self.square[np.maximum(nodes, 0)] - 2 * dots + q_square[:, None], np.inf)

    def _spread(self, nodes: np.ndarray, away: np.ndarray, most: int) -> np.ndarray:
        """Neighbours that are nearer to the node than to a neighbour taken before, then the nearest others."""
        order = np.argsort(away, axis=1, kind="stable")[:, : most * 2]
        nodes, away = np.take_along_axis(nodes, order, 1), np.take_along_axis(away, order, 1)
        again = np.zeros(nodes.shape, bool)
        for i in range(1, nodes.shape[1]):
            again[:, i] = (nodes[:, :i] == nodes[:, i : i + 1]).any(axis=1)
        valid = (nodes >= 0) & ~again & np.isfinite(away)
        taken = np.zeros(nodes.shape, bool)
        vectors, squares = self.x[np.maximum(nodes, 0)], self.square[np.maximum(nodes, 0)]
        between = squares[:, :, None] + squares[:, None, :] - 2 * np.einsum("bid,bjd->bij", vectors, vectors, optimize=True)
        for i in range(nodes.shape[1]):
            shaded = (taken[:, :i] & (between[:, i, :i] < away[:, i : i + 1])).any(axis=1)
            taken[:, i] = valid[:, i] & ~shaded
        rank = np.where(taken, 0, np.where(valid, 1, 2)) * nodes.shape[1] + np.arange(nodes.shape[1])
        best = np.argsort(rank, axis=1, kind="stable")[:, :most]
        out = np.where(np.take_along_axis(valid, best, 1), np.take_along_axis(nodes, best, 1), -1)
        if out.shape[1] < most:
            out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
        return out.astype(np.int32)

    def walk(self, q: np.ndarray, start: np.ndarray, layer: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest nodes that a best-first walk of a layer finds, for each query; -1 for none."""
        table, b = self.layers[layer], len(q)
        q_square = np.einsum("ij,ij->i", q, q)
        seen = np.zeros((b, len(self.x)), bool)
        rows = np.arange(b)
        best = np.full((b, width), -1, np.int32)
        away = np.full((b, width), np.inf)
        walked = np.ones((b, width), bool)
        fresh = start
        while True:
            known = (fresh < 0) | seen[rows[:, None], np.maximum(fresh, 0)]
            first = np.where(known, -1, fresh)
            seen[np.repeat(rows, fresh.shape[1]), np.maximum(fresh, 0).ravel()] |= (fresh >= 0).ravel()
            dist = self._from(q, q_square, first)
            nodes = np.concatenate([best, first], axis=1)
            away = np.concatenate([away, dist], axis=1)
            walked = np.concatenate([walked, first < 0], axis=1)
            keep = np.argsort(away, axis=1, kind="stable")[:, :width]
            best, away, walked = (np.take_along_axis(v, keep, 1) for v in (nodes, away, walked))
            next_ = np.argmin(np.where(walked | ~np.isfinite(away), np.inf, away), axis=1)
            open_ = ~walked[rows, next_] & np.isfinite(away[rows, next_])
            if not open_.any():
                return best, away
            walked[rows, next_] = True
            fresh = np.where(open_[:, None], table[np.maximum(best[rows, next_], 0)], -1)

    def search(self, q: np.ndarray, k: int, width: int = SEARCH_WIDTH) -> np.ndarray:
        """(queries, k) node numbers, nearest first; -1 for none."""
        q = q.astype(np.float32)
        start = np.full((len(q), 1), self.entry, np.int32)
        for layer in range(len(self.layers) - 1, 0, -1):
            start = self.walk(q, start, layer, 4)[0]
        return self.walk(q, start, 0, max(width, k))[0][:, :k]

    def arrays(self) -> dict:
        return {"entry": self.entry, "layers": [t.tobytes() for t in self.layers]}

    @classmethod
    def load(cls, vectors: np.ndarray, entry: int, layers: list[bytes]) -> Graph:
        graph = cls.__new__(cls)
        graph.x = vectors.astype(np.float32)
        graph.square = np.einsum("ij,ij->i", graph.x, graph.x)
        graph.entry = entry
        graph.layers = [np.frombuffer(t, np.int32).reshape(len(vectors), -1) for t in layers]
        return graph


def _level_long(vectors: np.ndarray) -> np.ndarray:
    """One more coordinate that makes all rows as long as the longest."""
    square = np.einsum("ij,ij->i", vectors, vectors)
    return np.column_stack([vectors, np.sqrt(np.maximum(square.max(initial=0) - square, 0))])


_INDEX = "shard int, entry int, layers array<binary>, nodes array<long>, owners array<long>, vectors binary"


def _build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("node")
    vectors = np.array(pdf["vector"].tolist(), np.float64)
    shard = int(pdf["shard"].iloc[0])
    made = Graph(_level_long(vectors), seed=shard).arrays()
    owners = [x[0] if len(x) else None for x in pdf["owner"]]
    row = {"shard": shard, **made, "nodes": pdf["node"].tolist(), "owners": owners, "vectors": vectors.tobytes()}
    return pd.DataFrame([row])


_FOUND = "query long, own long, node long, score double"


def _owned(owners: list) -> tuple[np.ndarray, np.ndarray]:
    """Ids that own nodes of a shard, in order, with the places of these nodes."""
    place = np.array([i for i, o in enumerate(owners) if o is not None], np.int64)
    owner = np.array([o for o in owners if o is not None], np.int64)
    order = np.argsort(owner, kind="stable")
    return owner[order], place[order]


def _scan(q: np.ndarray, vectors: np.ndarray, barred: list[np.ndarray], k: int) -> np.ndarray:
    """The nodes with the largest inner products out of all but the barred ones; -1 for none."""
    score = q @ vectors.T
    for i, nodes in enumerate(barred):
        score[i, nodes] = -np.inf
    best = np.argsort(-score, axis=1, kind="stable")[:, :k]
    return np.where(np.isfinite(np.take_along_axis(score, best, 1)), best, -1)


def _search_others(graph: Graph, vectors: np.ndarray, q: np.ndarray, barred: list[np.ndarray], k: int) -> np.ndarray:
    """As ``graph.search``, without the barred nodes of each query."""
    out = np.full((len(q), k), -1, np.int64)
    most = np.array([len(x) for x in barred])
    for rows, walks in ((np.flatnonzero(most <= SEARCH_WIDTH), True), (np.flatnonzero(most > SEARCH_WIDTH), False)):
        if not len(rows):
            continue
        away = [barred[i] for i in rows]
        if walks:
            more = int(most[rows].max())
            found = graph.search(np.column_stack([q[rows], np.zeros(len(rows))]), k + more, SEARCH_WIDTH + more)
            gone = np.array([np.isin(f, a) for f, a in zip(found, away, strict=True)])
            keep = np.argsort(gone | (found < 0), axis=1, kind="stable")[:, :k]
            found = np.take_along_axis(np.where(gone, -1, found), keep, 1)
        else:
            found = _scan(q[rows], vectors, away, k)
        out[rows, : found.shape[1]] = found
    return out


def _search_shards(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows of a partition: of each shard first its index, then the queries."""
    graph = nodes = vectors = owned = None
    for batch in batches:
        shards = batch.column("shard").to_numpy(zero_copy_only=False)
        is_index = batch.column("is_index").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((shards[1:] != shards[:-1]) | is_index[1:] | is_index[:-1]) + 1), len(shards)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(a, b - a)
            if is_index[a]:
                row = part.to_pylist()[0]
                nodes, owned = np.array(row["nodes"], np.int64), _owned(row["owners"])
                vectors = np.frombuffer(row["vectors"], np.float64).reshape(len(nodes), -1)
                graph = Graph.load(_level_long(vectors), row["entry"], row["layers"])
                continue
            queries, own = part.column("query").to_numpy(), part.column("own")
            x = np.array(part.column("vector").to_pylist(), np.float64)
            single = own.is_null().to_numpy(zero_copy_only=False)
            for which in (np.flatnonzero(single), np.flatnonzero(~single)):
                for i in range(0, len(which), TOGETHER):
                    at = which[i : i + TOGETHER]
                    if single[at[0]]:
                        found = graph.search(np.column_stack([x[at], np.zeros(len(at))]), k)
                    else:
                        ids = np.array(own.take(pa.array(at)).to_pylist(), np.int64)
                        low, high = (np.searchsorted(owned[0], ids, side) for side in ("left", "right"))
                        barred = [owned[1][m:n] for m, n in zip(low, high, strict=True)]
                        found = _search_others(graph, vectors, x[at], barred, k)
                    score = np.einsum("bd,bkd->bk", x[at], vectors[np.maximum(found, 0)])
                    row, col = np.nonzero(found >= 0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(queries[at][row]), own.take(pa.array(at[row])), pa.array(nodes[found[row, col]]), pa.array(score[row, col])],
                        names=["query", "own", "node", "score"],
                    )


def _usable(table: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, vector) of the vectors that take part, in double precision."""
    x = F.col(vector).cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = table.select(F.col(vec_id).alias("vec_id"), x.alias("vector")).where(
        F.coalesce(sound, F.lit(False)) & F.exists("vector", lambda v: v != 0)
    )
    sizes = rows.groupBy(F.size("vector").alias("d")).count()
    usual = sizes.agg(F.max(F.struct("count", "d")).alias("m")).first()["m"]
    return rows.where(F.size("vector") == (usual["d"] if usual else 0))


def nearest(
    table: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", vector: str = "embedding", shard: int = SHARD
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of every id that is divisible by ``every``."""
    rows = _usable(table, vec_id, vector)
    rows = pinned(rows, "ann-rows")
    # the node of equal vectors; its number is unique because it is the place of one written row
    one_id = (F.count("vec_id") == F.count(F.lit(1))) & (F.min("vec_id") == F.max("vec_id"))
    nodes = rows.groupBy("vector").agg(F.when(one_id, F.min("vec_id")).cast("long").alias("owner"))
    nodes = pinned(nodes.withColumn("node", F.monotonically_increasing_id()), "ann-nodes")
    shards = -(-nodes.count() // shard) or 1
    dealt = nodes.select(
        F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("shard"), "node", "vector",
        F.array_compact(F.array("owner")).alias("owner"),
    )
    index = pinned(dealt.groupBy("shard").applyInPandas(_build_shard, _INDEX), "ann-index")

    numbered = rows.join(nodes.select("vector", "node"), "vector")
    # rows of k ids and of the query's own, and of an id no more rows than k
    first = W.partitionBy("node").orderBy(F.col("vec_id").asc_nulls_last())
    copies = numbered.groupBy("node", "vec_id").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("copies"))
    members = pinned(copies.withColumn("_no", F.row_number().over(first)).where(F.col("_no") <= k + 1).drop("_no"), "ann-members")
    asked = numbered.where(F.col("vec_id") % every == 0).groupBy("vec_id", "node").agg(F.first("vector").alias("vector"))
    asked = pinned(asked, "ann-asked")
    # an id with several vectors searches by itself; all others share the search of their node
    several = asked.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id", F.col("vec_id").cast("long").alias("own"))
    asked = pinned(asked.join(several, "vec_id", "left"), "ann-searches")
    queries = asked.groupBy(F.col("node").alias("query"), "own").agg(F.first("vector").alias("vector"))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    left = index.select(F.lit(True).alias("is_index"), "shard", "entry", "layers", "nodes", "owners", "vectors",
                        F.lit(None).cast("long").alias("query"), F.lit(None).cast("long").alias("own"),
                        F.lit(None).cast("array<double>").alias("vector"))
    right = queries.select("query", "own", "vector", everywhere).select(
        F.lit(False).alias("is_index"), "shard", F.lit(None).cast("int").alias("entry"),
        F.lit(None).cast("array<binary>").alias("layers"), F.lit(None).cast("array<long>").alias("nodes"),
        F.lit(None).cast("array<long>").alias("owners"), F.lit(None).cast("binary").alias("vectors"), "query", "own", "vector",
    )
    together = left.unionByName(right).repartition(shards, "shard").sortWithinPartitions("shard", F.desc("is_index"))
    found = together.mapInArrow(lambda b: _search_shards(b, k + 1), _FOUND)
    best = W.partitionBy("query", "own").orderBy(F.desc("score"), "node")
    merged = found.withColumn("_no", F.row_number().over(best)).where(F.col("_no") <= k + 1).drop("_no")
    merged = pinned(merged, "ann-merged")
    # members of the merged nodes, as long as fewer than k + 1 ids stand before them: one of these may be the asking one
    per_search = W.partitionBy("query", "own").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "node")
    per_id = W.partitionBy("query", "own", "vec_id").orderBy(F.desc("score"), "node")
    new_id = F.when(F.row_number().over(per_id) == 1, 1).otherwise(0)
    before = F.coalesce(F.sum("_new").over(per_search.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    candidates = merged.join(members, "node").withColumn("_new", new_id).withColumn("_ids", before).where(F.col("_ids") <= k)
    asking = asked.select(F.col("vec_id").alias("query_id"), F.col("node").alias("query"), F.col("own").alias("_own"))
    answers = asking.join(
        candidates.select("query", "own", "node", "vec_id", "copies", "score"),
        (asking["query"] == candidates["query"]) & asking["_own"].eqNullSafe(candidates["own"]),
    )
    others = answers.where(~F.col("vec_id").eqNullSafe(F.col("query_id")))
    # a row that several vectors of an id find counts once
    once = others.groupBy("query_id", "node", "vec_id", "copies").agg(F.max("score").alias("score"))
    rows_ = once.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1), "copies")).alias("_copy"))
    rank = W.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = rows_.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
