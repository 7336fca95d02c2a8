"""Exact top-k by inner product: cover trees over the queries and over the data, walked together."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactlens.llm.common import columns_of

SCALE = 256
MOST_SQUARES = 2.0**61  # of a scaled vector
BLOCK_ROWS = 8192  # vectors in one data block, so in one tree
QUERY_BLOCK_ROWS = 2048
LEAF_ROWS = 48
EXACT_DOUBLE = 2.0**53


@dataclass
class Node:
    """A ball around ``center`` that covers ``rows``; a node has children or keeps its rows itself."""

    center: np.ndarray
    radius: float
    rows: np.ndarray
    children: list[Node] = field(default_factory=list)


def cover_tree(points: np.ndarray, rows: np.ndarray | None = None) -> Node:
    """A tree of covering balls: the points of a node are dealt to centres that lie more than half its radius apart, each
    point to the first centre within that distance.  Few points, or equal ones, are a leaf."""
    rows = np.arange(len(points)) if rows is None else rows
    root = _node(points, rows)
    open_nodes = [root]
    while open_nodes:
        node = open_nodes.pop()
        if len(node.rows) <= LEAF_ROWS or node.radius == 0:
            continue
        left, small = node.rows, []
        while len(left):
            distance = np.sqrt(np.maximum(0.0, ((points[left] - points[left[0]]) ** 2).sum(axis=1)))
            near = distance <= node.radius / 2
            near[0] = True
            if near.sum() == len(node.rows):  # a ball that halving does not split
                break
            if near.sum() < 8:
                small.append(left[near])
            else:
                node.children.append(_node(points, left[near]))
            left = left[~near]
            if len(small) >= 4 * LEAF_ROWS and not node.children:
                small.append(left)  # almost every point is a centre: covers at this scale tell nothing apart
                break
        if len(left) and not small and not node.children:
            continue
        lone = np.concatenate(small) if small else left[:0]
        for i in range(0, len(lone), LEAF_ROWS):
            node.children.append(_node(points, lone[i : i + LEAF_ROWS]))
        open_nodes += [c for c in node.children if len(c.rows) > LEAF_ROWS]
    return root


def _node(points: np.ndarray, rows: np.ndarray) -> Node:
    center = points[rows].mean(axis=0) if len(rows) > 1 else points[rows[0]].astype(np.float64)
    radius = float(np.sqrt(((points[rows] - center) ** 2).sum(axis=1).max()))
    return Node(center, radius, rows)


def _scores(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Integer inner products: by doubles where they are exact there, else by Python's integers."""
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * max(1, queries.shape[1])
    if largest < EXACT_DOUBLE:
        return (queries.astype(np.float64) @ data.astype(np.float64).T).astype(np.int64)
    if largest < 2.0**63:
        return queries.astype(np.int64) @ data.astype(np.int64).T
    return queries.astype(object) @ data.astype(object).T


class Best:
    """The ``k`` best (score, id) of every query so far, ties to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.found: list[list[tuple[int, int]]] = [[] for _ in range(queries)]
        self.worst = np.full(queries, -np.inf)

    def offer(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = np.flatnonzero(scores.astype(np.float64) >= self.worst[query])
        if len(keep):
            pairs = self.found[query] + [(-s, i) for s, i in zip(scores[keep].tolist(), ids[keep].tolist(), strict=True)]
            self.found[query] = sorted(pairs)[: self.k]
            if len(self.found[query]) == self.k:
                # one below in doubles, so that a score rounded down is still not less
                self.worst[query] = np.nextafter(float(-self.found[query][-1][0]), -np.inf)


def dual_search(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int) -> Best:
    """The ``k`` best rows of ``data`` for every row of ``queries``, other ids only.

    Both trees are walked together, best bounds first.  For a query ball (q, s) and a data ball (c, r) no inner product
    exceeds q.c + |q| r + |c| s + s r; the pair is pruned when that is below the worst k-th score in the query ball.
    """
    best = Best(len(queries), k)
    queries_f, data_f = queries.astype(np.float64), data.astype(np.float64)
    slack = 1e-9 * max(1.0, float(np.linalg.norm(queries_f, axis=1).max(initial=0)) * float(np.linalg.norm(data_f, axis=1).max(initial=0)))

    def bounds(q: Node, nodes: list[Node]) -> np.ndarray:
        centers, radii = np.stack([n.center for n in nodes]), np.array([n.radius for n in nodes])
        return centers @ q.center + np.linalg.norm(q.center) * radii + np.linalg.norm(centers, axis=1) * q.radius + q.radius * radii + slack

    todo = [(cover_tree(queries_f), [cover_tree(data_f)])]
    while todo:
        q, nodes = todo.pop()
        bound = bounds(q, nodes)
        order = np.argsort(-bound, kind="stable")
        if q.children:
            worst = best.worst[q.rows].min()
            left = [nodes[i] for i in order if bound[i] >= worst]
            if left:
                todo += [(child, left) for child in q.children]
            continue
        for i in order:
            if bound[i] < best.worst[q.rows].min():
                break
            node = nodes[i]
            if node.children:
                todo.append((q, node.children))
                continue
            scores = _scores(queries[q.rows], data[node.rows])
            reach = scores.astype(np.float64).max(axis=1) >= best.worst[q.rows]
            for row in np.flatnonzero(reach):
                query = q.rows[row]
                other = data_ids[node.rows] != query_ids[query]
                best.offer(query, scores[row][other], data_ids[node.rows][other])
    return best


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, v`` with integer components; vectors that are null, or hold a null or a number that is not finite, go.

    A vector whose square sum reaches MOST_SQUARES fails the query with a message: below it no inner product leaves 64 bits.
    """
    x = F.col("embedding").cast("array<double>")
    limits = [F.lit(float("inf")), F.lit(float("-inf")), F.lit(float("nan"))]
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (e != limits[0]) & (e != limits[1]))
    rows = columns_of(vectors, "vec_id", "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(finite)
    squares = F.aggregate(x, F.lit(0.0), lambda n, e: n + (e * scale) * (e * scale))
    fits = F.when(squares < MOST_SQUARES, x).otherwise(F.raise_error(F.lit("nearest: a vector is too long for 64-bit scores")).cast("array<double>"))
    return rows.select("vec_id", F.transform(fits, lambda e: F.floor(e * scale)).alias("v"))


def top_k(data: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of ``data`` with the highest inner products for every query.

    Both inputs are ``vec_id, v`` (integers).  Data and queries are dealt into blocks of bounded size by a hash of id
    and content; a task gets one block of each, so memory does not grow with either table, and returns at most ``k``
    rows per query.  What is shuffled behind that is ``k`` rows per query and data block.

    Defined cases: ties go to the smaller ``vec_id``; a query is never its own candidate, nor is a row with its id; vectors
    of other lengths are no candidates; a vector without components scores 0 with its like; equal rows count each; a
    query with fewer than ``k`` candidates gets them all, without any it gets no row; further columns are ignored.
    """
    sizes = data.count(), queries.count()
    blocks, query_blocks = (max(1, -(-n // most)) for n, most in zip(sizes, (BLOCK_ROWS, QUERY_BLOCK_ROWS), strict=True))

    def dealt(rows: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        placed = rows.select(F.size("v").alias("dims"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_own)).cast("int").alias(own), "vec_id", "v")
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    left = dealt(data, "block", blocks, "query_block", query_blocks).groupBy("dims", "block", "query_block")
    right = dealt(queries, "query_block", query_blocks, "block", blocks).groupBy("dims", "block", "query_block")

    def search(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(wanted):
            data_v, query_v = np.stack(rows["v"].to_list()), np.stack(wanted["v"].to_list())
            ids, query_ids = rows["vec_id"].to_numpy(), wanted["vec_id"].to_numpy()
            best = dual_search(query_v, query_ids, data_v, ids, k)
            out = [(int(q), i, -s) for q, found in zip(query_ids, best.found, strict=True) for s, i in found]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = left.cogroup(right).applyInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """:func:`top_k` of all vectors, with the rows whose ``vec_id`` is divisible by ``every`` as queries."""
    rows = quantized(vectors)
    return top_k(rows, rows.where(F.col("vec_id") % every == 0), k)
