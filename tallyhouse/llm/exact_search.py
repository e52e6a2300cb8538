"""Exact top-k search by inner product: a ball tree per shard, searched by branch and bound.

Vectors are dealt to shards by content. A task builds the ball tree of its shard and answers every query: a ball with centre c
and radius r holds no inner product with q above q.c + |q| r, so balls are opened in the order of that bound until it falls below
the kth score so far; a batch of queries shares the opening of a ball. The kth score is shared among shards: a first round opens one leaf per shard
and query, and the kth best of all that is where every shard starts in the second round.

Rows whose id or vector is null, or whose vector holds a null or non-finite component, take no part. Vectors of different
lengths are not compared. Equal vectors are one point with several ids; rows with a query's id are never its neighbours. Several rows with
one query's id are answered together. No vectors: no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.storage import saved
from tallyhouse.llm.vectors import SHARD_ROWS, best, finite, merged, searched, sharded

LEAF = 32
EXACT = float(1 << 53)  # integers up to here are exact in double


class BallTree:
    """Balls as flat arrays; the points lie in the order of the leaves."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        start, stop, children, centre, radius = [], [], [], [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            node, own = len(start), points[self.order[lo:hi]]
            middle = own.mean(axis=0)
            far = np.linalg.norm(own - middle, axis=1)
            start.append(lo), stop.append(hi), children.append([-1, -1]), centre.append(middle), radius.append(far.max())
            if parent >= 0:
                children[parent][side] = node
            if hi - lo > leaf and far.max() > 0:
                a = own[far.argmax()]
                b = own[np.linalg.norm(own - a, axis=1).argmax()]
                half = (hi - lo) // 2
                self.order[lo:hi] = self.order[lo:hi][np.argpartition(own @ (b - a), half)]
                todo += [(lo, lo + half, node, 0), (lo + half, hi, node, 1)]
        self.start, self.stop, self.children = start, stop, children
        self.centre, self.radius = np.array(centre), np.array(radius)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The highest inner product a ball can hold, per query and ball, with room for rounding."""
        length = np.linalg.norm(queries, axis=1)[:, None]
        above = queries @ self.centre.T + length * self.radius
        return above + 1e-9 * (np.abs(above) + length * (self.radius + np.linalg.norm(self.centre, axis=1)) + 1)


class Best:
    """The k best (score, id) of a query, each id once, ties to the smaller id; never below the floor it starts from."""

    def __init__(self, query: int, k: int, floor: float):
        self.query, self.k, self.floor = query, k, -np.inf if np.isnan(floor) else floor
        self.top: list[tuple[int, int]] = []  # (score, minus id), the worst first
        self.held: dict[int, int] = {}  # id -> its score in top

    def kth(self) -> float:
        return max(self.top[0][0], self.floor) if len(self.top) == self.k else self.floor

    def take(self, own: int, score: int) -> None:
        if own == self.query or self.held.get(own, score - 1) >= score:
            return
        entry = (score, -own)
        if own in self.held:
            self.top[self.top.index((self.held[own], -own))] = entry
            heapq.heapify(self.top)
        elif len(self.top) < self.k:
            heapq.heappush(self.top, entry)
        elif entry > self.top[0]:
            del self.held[-heapq.heapreplace(self.top, entry)[1]]
        else:
            return
        self.held[own] = score


def _seeded(tree: BallTree, bounds: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(leaf, queries): each query at one leaf, reached by the child with the higher bound at every node."""
    found, todo = [], [(0, np.arange(len(bounds)))]
    while todo:
        node, own = todo.pop()
        left, right = tree.children[node]
        if left < 0:
            found.append((node, own))
            continue
        goes = bounds[own, left] >= bounds[own, right]
        todo += [(child, part) for child, part in ((left, own[goes]), (right, own[~goes])) if len(part)]
    return found


def _opened(tree: BallTree, bounds: np.ndarray, reach: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, queries): the leaves by bound, highest first, each with the queries whose kth score (`reach`, which rises meanwhile) it may reach."""
    heap = [(-bounds[:, 0].max(initial=-np.inf), 0)]
    while heap:
        _, node = heapq.heappop(heap)
        own = np.flatnonzero(bounds[:, node] >= reach)
        if not len(own):
            continue
        left, right = tree.children[node]
        if left < 0:
            yield node, own
        else:
            for child in (left, right):
                heapq.heappush(heap, (-bounds[own, child].max(), child))


def tree_search(k: int, first_leaf_only: bool, leaf: int = LEAF) -> Callable:
    """The search of one shard, for `vectors.searched`. A query's floor is the kth score known so far, or null.

    A batch of queries goes through the tree together. Balls are opened in the order of the highest bound any query has there; a ball
    is left out for the queries whose kth score its bound does not reach, and a leaf's points meet all others in one product.
    """

    def index(ids: list, vectors: np.ndarray) -> Callable:
        tree = BallTree(vectors, leaf)
        points = vectors[tree.order]
        owners = [[int(own) for own in ids[i]] for i in tree.order]
        large = np.abs(points).max(initial=0)

        def products(lo: int, hi: int, queries: np.ndarray, wide: bool) -> np.ndarray:
            if wide:
                return queries.astype(np.int64) @ points[lo:hi].astype(np.int64).T
            return (queries @ points[lo:hi].T).astype(np.int64)

        def answer(query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray) -> pd.DataFrame:
            bounds = tree.bounds(queries)
            best = [Best(int(query), k, floor) for query, floor in zip(query_ids, floors, strict=True)]
            reach = np.array([b.floor for b in best])  # the kth scores
            wide = max(large, np.abs(queries).max(initial=0)) ** 2 * max(1, points.shape[1]) >= EXACT

            def meet(node: int, own: np.ndarray) -> None:
                lo, hi = tree.start[node], tree.stop[node]
                scores = products(lo, hi, queries[own], wide)
                rows, places = np.nonzero(scores >= reach[own, None])
                if first_leaf_only:  # any k of a leaf give a floor: its best points will do
                    kept = np.argsort(-scores, axis=1, kind="stable")[:, : k + 1]
                    rows, places = np.repeat(np.arange(len(own)), kept.shape[1]), kept.ravel()
                for row, place, score in zip(rows.tolist(), places.tolist(), scores[rows, places].tolist(), strict=True):
                    for owner in owners[lo + place]:
                        best[own[row]].take(owner, score)
                for row in np.unique(rows):
                    reach[own[row]] = best[own[row]].kth()

            if first_leaf_only:
                for node, own in _seeded(tree, bounds):
                    meet(node, own)
            else:
                for node, own in _opened(tree, bounds, reach):
                    meet(node, own)
            return pd.DataFrame([(b.query, -minus, score) for b in best for score, minus in b.top], columns=["query_id", "vec_id", "score"])

        return answer

    return index


def whole_components(vector: str, scale: int) -> F.Column:
    """floor(scale * x) for each component x, computed in double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query, all if there are fewer, ties to the smaller id.

    `vectors` and `queries` have the columns id and vec (whole numbers as array<double>). Scores are exact 64-bit integers; components whose
    products leave that range wrap around.
    """
    usable = [frame.where(F.col("id").isNotNull() & finite("vec")).select("id", "vec") for frame in (vectors, queries)]
    nodes, shards = sharded(merged(usable[0], k), shard_rows)
    asked = usable[1].distinct().select(F.col("id").alias("query_id"), "vec")
    seeds = searched(nodes, asked.withColumn("floor", F.lit(None).cast("double")), shards, tree_search(k, first_leaf_only=True), "long")
    known = best(seeds, k).where(F.col("rank") == k).select("query_id", (F.col("score") - F.abs("score") * 1e-12).alias("floor"))
    shared = saved(asked.join(known, "query_id", "left"), "queries")
    return best(searched(nodes, shared, shards, tree_search(k, first_leaf_only=False), "long"), k)
