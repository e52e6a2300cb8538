"""Approximate nearest neighbours by cosine: a hierarchical navigable small-world graph per shard (Malkov and Yashunin, 2016).

Vectors are dealt to shards by content; a task builds the graph of its shard as flat neighbour arrays, one per layer, and answers
every query; the shards' results are merged. Points are added in batches: a batch searches the graph built so far in
lockstep, and its points are candidates of one another. Links are chosen by the paper's heuristic, which keeps links in different
directions. Scores are the cosines of the original vectors in double precision; only which rows are found is approximate.

Rows whose id or vector is null, or whose vector is zero or holds a null or non-finite component, take no part. Vectors of different
lengths are not compared. Equal vectors are one point with several ids; rows with a query's id are never its neighbours. A shard
with no more points than a search keeps is compared in full, so few rows are found whole. Where the vectors of few ids fill a search's view,
it is widened until k ids are found or the shard is compared in full. No vectors: no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.vectors import SHARD_ROWS, best, finite, merged, searched, sharded

LINKS = 16  # per point and layer, twice as many in the lowest
WIDTH_BUILDING = 64
WIDTH = 96  # points that a search keeps in view
BATCH = 128
SEED = 7


def _unit(vectors: np.ndarray) -> np.ndarray:
    large = np.abs(vectors).max(axis=1, keepdims=True, initial=0)
    scaled = vectors / np.where(large > 0, large, 1)
    return scaled / np.maximum(np.linalg.norm(scaled, axis=1, keepdims=True), 1e-300)


class Graph:
    """`layers[l]` has a row of neighbours for every point, -1 where there are fewer."""

    def __init__(self, vectors: np.ndarray, links: int = LINKS, width: int = WIDTH_BUILDING, seed: int = SEED):
        self.unit = _unit(vectors).astype(np.float32)
        n, draw = len(vectors), np.random.default_rng(seed)
        self.level = np.minimum((-np.log(1 - draw.random(n)) / np.log(links)).astype(int), 8)
        self.level[:1] = self.level.max(initial=0)
        self.layers = [np.full((n, links * (1 if layer else 2)), -1, dtype=np.int32) for layer in range(self.level.max(initial=0) + 1)]
        for lo in range(1, n, BATCH):
            self._add(np.arange(lo, min(n, lo + BATCH)), width)

    def _view(self, queries: np.ndarray, layer: int, enter: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The points nearest to each query that a search in one layer keeps, nearest first, and their cosines; -1 where there are fewer."""
        rows, b = np.arange(len(queries)), len(queries)
        seen = np.zeros((b, len(self.unit) + 1), dtype=bool)  # the last column stands for "no point"
        seen[:, -1] = True
        near = np.full((b, width), -1, dtype=np.int64)
        far = np.full((b, width), -np.inf, dtype=np.float32)
        opened = np.zeros((b, width), dtype=bool)
        take = min(width, enter.shape[1])
        near[:, :take] = enter[:, :take]
        far[:, :take] = np.where(near[:, :take] >= 0, np.einsum("bkd,bd->bk", self.unit[near[:, :take]], queries), -np.inf)
        np.put_along_axis(seen, near[:, :take], True, axis=1)
        active = rows
        while len(active):
            open_score = np.where(opened[active] | (near[active] < 0), -np.inf, far[active])
            at = open_score.argmax(axis=1)
            going = open_score[np.arange(len(active)), at] > -np.inf
            active, at = active[going], at[going]
            if not len(active):
                break
            opened[active, at] = True
            reach = self.layers[layer][near[active, at]].astype(np.int64)
            reach = np.where(seen[active[:, None], reach], -1, reach)
            seen[active[:, None], reach] = True
            score = np.where(reach >= 0, np.einsum("bkd,bd->bk", self.unit[reach], queries[active]), -np.inf).astype(np.float32)
            every, scores = np.concatenate([near[active], reach], axis=1), np.concatenate([far[active], score], axis=1)
            flags = np.concatenate([opened[active], np.zeros(reach.shape, dtype=bool)], axis=1)
            keep = np.argpartition(-scores, width - 1, axis=1)[:, :width]
            near[active] = np.where(np.take_along_axis(scores, keep, 1) > -np.inf, np.take_along_axis(every, keep, 1), -1)
            far[active], opened[active] = np.take_along_axis(scores, keep, 1), np.take_along_axis(flags, keep, 1)
        order = np.argsort(-far, axis=1, kind="stable")
        return np.take_along_axis(near, order, 1), np.take_along_axis(far, order, 1)

    def _chosen(self, points: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
        """Up to `most` links per point out of its candidates: a candidate nearer to a chosen one than to the point is passed over, and comes last."""
        vectors = self.unit[near]
        score = np.where((near >= 0) & (near != points[:, None]), np.einsum("bkd,bd->bk", vectors, self.unit[points]), -np.inf)
        order = np.argsort(-score, axis=1, kind="stable")
        near, score = np.take_along_axis(near, order, 1), np.take_along_axis(score, order, 1)
        vectors = self.unit[near]
        between = np.einsum("bkd,bld->bkl", vectors, vectors)
        chosen = np.zeros(near.shape, dtype=bool)
        for i in range(near.shape[1]):
            hidden = (chosen & (between[:, i] > score[:, i, None])).any(axis=1)
            chosen[:, i] = ~hidden & (score[:, i] > -np.inf) & (chosen.sum(axis=1) < most)
        rank = np.argsort(np.where(chosen, 0, np.where(score > -np.inf, 1, 2)), axis=1, kind="stable")[:, :most]
        links = np.where(np.take_along_axis(score, rank, 1) > -np.inf, np.take_along_axis(near, rank, 1), -1)
        return np.pad(links, ((0, 0), (0, most - links.shape[1])), constant_values=-1)

    def _link(self, layer: int, points: np.ndarray, near: np.ndarray) -> None:
        table = self.layers[layer]
        most = table.shape[1]
        table[points] = self._chosen(points, near, most)
        source, target = np.repeat(points, most), table[points].ravel()
        there = target >= 0
        source, target = source[there], target[there].astype(np.int64)
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        ends, first, count = np.unique(target, return_index=True, return_counts=True)
        back = np.full((len(ends), count.max(initial=0)), -1, dtype=np.int64)
        back[np.repeat(np.arange(len(ends)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        known = table[ends].astype(np.int64)
        back = np.where((back[:, :, None] == known[:, None, :]).any(axis=2), -1, back)
        table[ends] = self._chosen(ends, np.concatenate([known, back], axis=1), most)

    def _add(self, points: np.ndarray, width: int) -> None:
        enter = np.zeros((len(points), 1), dtype=np.int64)
        own = self.unit[points]
        peers = own @ own.T
        np.fill_diagonal(peers, -np.inf)
        for layer in range(len(self.layers) - 1, -1, -1):
            joins = self.level[points] >= layer
            enter, _ = self._view(own, layer, enter, width if joins.any() else 1)
            if joins.any():
                beside = np.argsort(-np.where(joins[None, :], peers[joins], -np.inf), axis=1)[:, : self.layers[layer].shape[1]]
                beside = np.where(np.take_along_axis(np.where(joins[None, :], peers[joins], -np.inf), beside, 1) > -np.inf, points[beside], -1)
                self._link(layer, points[joins], np.concatenate([enter[joins], beside], axis=1))

    def search(self, queries: np.ndarray, width: int = WIDTH) -> np.ndarray:
        """Ids of the points nearest to each query, nearest first, -1 where there are fewer."""
        if len(self.unit) <= width:
            return np.tile(np.arange(len(self.unit)), (len(queries), 1))
        unit, enter = _unit(queries).astype(np.float32), np.zeros((len(queries), 1), dtype=np.int64)
        for layer in range(len(self.layers) - 1, 0, -1):
            enter, _ = self._view(unit, layer, enter, 1)
        return self._view(unit, 0, enter, width)[0]


def cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return (vectors @ query) / (np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum()))


def graph_search(k: int, width: int = WIDTH) -> Callable:
    """The search of one shard, for `vectors.searched`."""

    def index(ids: list, vectors: np.ndarray) -> Callable:
        graph = Graph(vectors)

        def scored(query: int, q: np.ndarray, found: np.ndarray) -> list[tuple[int, float]]:
            """The k best ids of the points found, each with its best score."""
            near = found[found >= 0]
            highest: dict[int, float] = {}
            for score, at in zip(cosines(q, vectors[near]), near, strict=True):
                for own in ids[at]:
                    if own != query and score > highest.get(own, -np.inf):
                        highest[own] = score
            return sorted(highest.items(), key=lambda hit: (-hit[1], hit[0]))[:k]

        def answer(query_ids: np.ndarray, queries: np.ndarray, _: np.ndarray) -> pd.DataFrame:
            out = []
            for lo in range(0, len(queries), BATCH):
                for query, q, found in zip(query_ids[lo : lo + BATCH], queries[lo : lo + BATCH], graph.search(queries[lo : lo + BATCH], width), strict=True):
                    hits, wide = scored(query, q, found), width
                    while len(hits) < k and wide < len(vectors):  # the vectors of few ids fill the view
                        wide *= 4
                        hits = scored(query, q, graph.search(q[None], wide)[0])
                    out += [(query, own, score) for own, score in hits]
            return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

        return answer

    return index


def nearest(vectors: DataFrame, queries: DataFrame, k: int, shard_rows: int = SHARD_ROWS, width: int = WIDTH) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest cosine found for each query, ties to the smaller id.

    `vectors` and `queries` have the columns id and vec (numbers). Every row is indexed.
    """
    length = F.exists("vec", lambda x: x != 0)
    usable = [frame.where(F.col("id").isNotNull() & finite("vec") & length).select("id", F.col("vec").cast("array<double>").alias("vec")) for frame in (vectors, queries)]
    nodes, shards = sharded(merged(usable[0], k), shard_rows)
    asked = usable[1].distinct().select(F.col("id").alias("query_id"), "vec", F.lit(None).cast("double").alias("floor"))
    return best(searched(nodes, asked, shards, graph_search(k, width), "double"), k)
