"""Exact top-k inner-product search by ball trees.

Vectors are whole numbers.  They are dealt into shards of bounded size by a hash
of their id, and each shard becomes one row that holds its ball tree.  Queries
come in blocks, and a block meets a tree at once.  A query visits the leaves whose
upper bound ``q . centre + |q| * radius``, and that of all nodes above, can reach its
kth score, the leaves with the highest bounds first.  That score is shared: a first pass over a few shards gives each query
a kth score to start from in all shards.  Bounds carry a margin for rounding, and
only strictly lower nodes are cut, so that ties are found; results are exact.

Defined cases: vectors that are null, or hold null or non-finite components, take
no part, and neither do rows without an id.  Rows that share an id are one vector
(the smallest).  Only vectors of the query's length are candidates.  Scores
beyond a long are held at its ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lokora.llm.common import partitions, pick, stage

SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 8192, 2048, 64
# Shards of the first pass, by which a query gets a kth score to start from.
PROBES = 2
TREES_AT_ONCE = 2
LOWEST = -(1 << 63)

TREE = "dim int, shard int, ids binary, vectors binary, nodes binary, centres binary, radii binary"
BLOCK = "dim int, block int, ids binary, vectors binary, least binary"


def whole_vectors(vectors: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """``(vec_id, v)`` with floor(scale * x) of each component, of the vectors that take part."""
    rows = pick(vectors, vec_id=id_col, x=vec_col).withColumn("vec_id", F.col("vec_id").cast("long"))
    x = F.col("x").cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & sound).select("vec_id", whole.alias("v"))


def _matrix(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, pd.DataFrame]:
    """Ids and vectors of a group, one row for each id."""
    group = group.reset_index(drop=True)
    vectors = np.stack(group["v"].to_numpy()).astype(np.int64, copy=False)
    group = group.drop(columns="v").sort_values("vec_id", kind="stable")
    if group["vec_id"].duplicated().any():
        by_vector = np.lexsort(vectors.T[::-1]) if vectors.shape[1] else np.arange(len(vectors))
        group = group.loc[by_vector].sort_values("vec_id", kind="stable").drop_duplicates("vec_id")
    return group["vec_id"].to_numpy(np.int64), vectors[group.index], group


def build_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row order, nodes ``(start, end, left child, right child)``, centres and radii.

    A node is split at the median of the projections on the line between two far
    apart members; -1 marks a leaf.
    """
    points = vectors.astype(float)
    order = np.arange(len(points))
    nodes, centres, radii = [], [], []

    def grow(start: int, end: int) -> int:
        me = len(nodes)
        own = points[order[start:end]]
        centre = own.mean(0)
        radius = float(np.sqrt(((own - centre) ** 2).sum(1)).max())
        nodes.append([start, end, -1, -1])
        centres.append(centre)
        radii.append(radius)
        if end - start > LEAF_ROWS and radius > 0:
            a = own[((own - own[0]) ** 2).sum(1).argmax()]
            b = own[((own - a) ** 2).sum(1).argmax()]
            middle = (end - start) // 2
            order[start:end] = order[start:end][np.argpartition(own @ (b - a), middle)]
            nodes[me][2] = grow(start, start + middle)
            nodes[me][3] = grow(start + middle, end)
        return me

    grow(0, len(points))
    return order, np.array(nodes, np.int64), np.array(centres), np.array(radii)


class Tree:
    def __init__(self, ids, vectors, nodes, centres, radii, dim: int) -> None:
        self.ids = np.frombuffer(ids, np.int64)
        self.vectors = np.frombuffer(vectors, np.int64).reshape(len(self.ids), dim)
        self.points = self.vectors.astype(float)
        self.nodes = np.frombuffer(nodes, np.int64).reshape(-1, 4).tolist()
        self.centres = np.frombuffer(centres, float).reshape(len(self.nodes), dim)
        self.radii = np.frombuffer(radii, float)
        self.largest = _largest(self.vectors)

    def scores(self, start: int, end: int, queries: np.ndarray) -> np.ndarray:
        """A row for each query, exact: floats hold whole numbers below 2^53."""
        most = self.largest * _largest(queries) * max(1, queries.shape[1])
        if most < 1 << 53:
            return (queries.astype(float) @ self.points[start:end].T).astype(np.int64)
        if most < 1 << 62:
            return queries @ self.vectors[start:end].T
        exact = queries.astype(object) @ self.vectors[start:end].T.astype(object)
        held = [[min(max(int(s), LOWEST), -LOWEST - 1) for s in row] for row in exact]
        return np.array(held, np.int64).reshape(exact.shape)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Of each node (row) and query, no higher than those of the nodes above."""
        real = queries.astype(float)
        norms = np.sqrt((real * real).sum(1))
        bounds = self.centres @ real.T + np.outer(self.radii, norms)
        bounds += 1e-9 * np.abs(bounds) + 1e-9 * norms * (1 + np.abs(self.centres).max(initial=0)) + 1e-6
        for node, (_, _, left, right) in enumerate(self.nodes):  # parents stand before their children
            if left >= 0:
                np.minimum(bounds[left], bounds[node], out=bounds[left])
                np.minimum(bounds[right], bounds[node], out=bounds[right])
        return bounds

    def search_all(self, own: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, ...]:
        """``(row, vec_id, score)`` of at most k vectors that may be among the best of each query row.

        Queries that reach a leaf are multiplied with it at once; a kth score that rises
        keeps its query from later leaves.
        """
        least = least.copy()
        scores, ids = np.full((len(own), k), LOWEST), np.zeros((len(own), k), np.int64)
        absent = np.ones((len(own), k), bool)
        bounds = self.bounds(queries)
        leaves = [node for node, (_, _, left, _) in enumerate(self.nodes) if left < 0]
        for node in sorted(leaves, key=lambda node: -bounds[node].sum()):
            start, end = self.nodes[node][:2]
            rows = np.flatnonzero(bounds[node] >= least)
            if not len(rows):
                continue
            new = self.scores(start, end, queries[rows])
            good = new >= least[rows, None]
            hit = good.any(1)
            rows, new, good = rows[hit], new[hit], good[hit]
            good &= self.ids[start:end] != own[rows, None]
            all_scores = np.hstack([scores[rows], new])
            all_ids = np.hstack([ids[rows], np.broadcast_to(self.ids[start:end], new.shape)])
            all_absent = np.hstack([absent[rows], ~good])
            # ~ puts the highest first and cannot overflow.
            first = np.lexsort((all_ids, ~all_scores, all_absent), axis=1)[:, :k]
            scores[rows] = np.take_along_axis(all_scores, first, 1)
            ids[rows] = np.take_along_axis(all_ids, first, 1)
            absent[rows] = np.take_along_axis(all_absent, first, 1)
            least[rows] = np.where(absent[rows, -1], least[rows], np.maximum(least[rows], scores[rows, -1]))
        row, place = np.nonzero(~absent)
        return row, ids[row, place], scores[row, place]

    def search(self, own_id: int, query: np.ndarray, k: int, least: int) -> list[tuple[int, int]]:
        """``(score, vec_id)`` of at most k vectors that may be among the query's best."""
        _, ids, scores = self.search_all(np.array([own_id]), query[None], k, np.array([least]))
        return list(zip(scores.tolist(), ids.tolist(), strict=True))


def _largest(values: np.ndarray) -> int:
    """The largest size of a value; of the lowest long, too."""
    return max(int(values.max(initial=0)), -int(values.min(initial=0)))


def build_trees(rows: DataFrame, shards: int) -> DataFrame:
    """One row for each shard of ``(vec_id, v)`` rows, per vector length."""

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        ids, vectors, _ = _matrix(group)
        order, nodes, centres, radii = build_tree(vectors)
        parts = (ids[order], vectors[order], nodes, centres, radii)
        row = [key[0], key[1], *[p.tobytes() for p in parts]]
        return pd.DataFrame([row], columns=[c.split()[0] for c in TREE.split(", ")])

    return _dealt(rows, "shard", shards).groupBy("dim", "shard").applyInPandas(build, TREE)


def _dealt(rows: DataFrame, name: str, n: int) -> DataFrame:
    part = F.pmod(F.xxhash64(F.lit(name), "vec_id"), F.lit(n)).cast("int")
    return rows.withColumn("dim", F.size("v")).withColumn(name, part)


def _blocks(queries: DataFrame, n: int) -> DataFrame:
    """Blocks of ``(vec_id, v, least)`` rows."""

    def gather(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        ids, vectors, group = _matrix(group)
        parts = (ids, vectors, group["least"].to_numpy(np.int64))
        row = [key[0], key[1], *[p.tobytes() for p in parts]]
        return pd.DataFrame([row], columns=[c.split()[0] for c in BLOCK.split(", ")])

    return _dealt(queries, "block", n).groupBy("dim", "block").applyInPandas(gather, BLOCK)


def _search(blocks: DataFrame, trees: DataFrame, shards: Column, k: int, n: int) -> DataFrame:
    """``(query_id, vec_id, score)``: each query's best in each of its block's ``shards``, ``n`` in all.

    A block goes to many shards, which the size of its table does not show: left to its
    own choice, Spark would gather blocks or trees in the driver to broadcast them.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                tree = Tree(row.ids, row.vectors, row.nodes, row.centres, row.radii, row.dim)
                ids = np.frombuffer(row.query_ids, np.int64)
                queries = np.frombuffer(row.queries, np.int64).reshape(len(ids), row.dim)
                at, vec_ids, scores = tree.search_all(ids, queries, k, np.frombuffer(row.least, np.int64))
                yield pd.DataFrame({"query_id": ids[at], "vec_id": vec_ids, "score": scores})

    parts = max(n, partitions(blocks.sparkSession))
    named = blocks.withColumnsRenamed({"ids": "query_ids", "vectors": "queries"})
    asked = named.select("*", F.explode(shards).alias("shard")).repartition(parts, "dim", "shard")
    pairs = asked.join(trees.repartition(parts, "dim", "shard").hint("merge"), ["dim", "shard"])
    return pairs.mapInPandas(find, "query_id long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def stage_few(df: DataFrame, name: str) -> DataFrame:
    """``stage``, while Python gets few rows at once: each holds a whole tree."""
    conf, size = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = conf.get(size)
    conf.set(size, str(TREES_AT_ONCE))
    try:
        return stage(df, name)
    finally:
        conf.set(size, usual)


def top_k(
    vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256,
    id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best of all other vectors for each row for
    which ``queries`` (over ``vec_id``) holds; ties go to the smaller vec_id."""
    rows = stage(whole_vectors(vectors, scale, id_col, vec_col), "vectors")
    asked = rows.filter(queries)
    shards = rows.count() // shard_rows + 1
    blocks = asked.count() // BLOCK_ROWS + 1
    trees = stage(build_trees(rows, shards), "trees")
    every = F.sequence(F.lit(0), F.lit(shards - 1))
    few = F.transform(
        F.sequence(F.lit(0), F.lit(min(PROBES, shards) - 1)), lambda i: F.pmod(F.col("block") + i, F.lit(shards))
    )
    first = stage(_blocks(asked.withColumn("least", F.lit(LOWEST)), blocks), "blocks")
    probed = _ranked(stage_few(_search(first, trees, few, k, shards), "probed"), k).filter(F.col("rank") == k)
    lows = probed.select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    known = asked.join(lows.hint("merge"), "vec_id", "left")
    second = stage(_blocks(known.fillna(LOWEST, ["least"]), blocks), "blocks")
    found = _ranked(stage_few(_search(second, trees, every, k, shards), "found"), k)
    return found.select("query_id", "rank", "vec_id", "score")
