"""What the vector searches share: usable vectors, merging of equal vectors, dealing shards and queries to tasks, final ranks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyhouse.llm.storage import saved

SHARD_ROWS = 4096  # distinct vectors of a shard, about
HITS = "query_id long, vec_id long, score {score}"


def finite(vector: str) -> Column:
    """Not null, and every component a finite number."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))


def merged(vectors: DataFrame, k: int) -> DataFrame:
    """(vec, ids): one row per distinct vector with its k + 1 smallest distinct ids, in order.

    A search for k neighbours never needs more ids of one vector, the query's own included. Repeated rows go first, as they would take
    other ids' places. The ids are cut before the shuffle by vector, so a vector with very many copies is no hot key.
    """
    ranked = vectors.select("id", "vec").distinct().withColumn("_rank", F.row_number().over(W.partitionBy("vec").orderBy("id"))).where(F.col("_rank") <= k + 1)
    return ranked.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def sharded(candidates: DataFrame, shard_rows: int) -> tuple[DataFrame, int]:
    """The merged vectors, stored, with the shard their content hashes to, and the number of shards."""
    nodes = saved(candidates, "vectors")
    shards = max(1, -(-nodes.count() // shard_rows))
    return nodes.withColumn("shard", F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int")), shards


def searched(nodes: DataFrame, queries: DataFrame, shards: int, search: Callable[[list, np.ndarray], Callable], score: str) -> DataFrame:
    """(query_id, vec_id, score): what every shard finds for every query.

    `queries` has query_id, vec and floor. A task holds one shard: its vectors come first and are handed to `search(ids, vectors)`,
    which returns a function for a batch of queries; these follow in batches, so memory is bounded by a shard and a batch.
    """
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "query_id", "floor",
                           F.lit(None).cast("array<long>").alias("ids"), "vec")
    held = nodes.select("shard", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("double").alias("floor"), "ids", "vec")
    dealt = held.unionByName(asked).repartitionById(shards, "shard").sortWithinPartitions("kind", F.col("ids")[0], "query_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, by_dim, indexes = [], {}, None
        for batch in batches:
            for kind, part in batch.groupby("kind"):
                if kind == 0:
                    found.append(part[["ids", "vec"]])
                    continue
                if indexes is None:
                    for rows in found:
                        for ids, vec in zip(rows["ids"], rows["vec"], strict=True):
                            by_dim.setdefault(len(vec), []).append((ids, vec))
                    indexes = {d: search([r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64).reshape(len(rows), d)) for d, rows in by_dim.items()}
                    found, by_dim = [], {}
                size = part["vec"].map(len)
                for d, own in part.groupby(size):
                    if d in indexes:
                        q = np.array(list(own["vec"]), dtype=np.float64).reshape(len(own), d)
                        yield indexes[d](own["query_id"].to_numpy(), q, own["floor"].to_numpy())

    return dealt.mapInPandas(run, HITS.format(score=score))


def best(hits: DataFrame, k: int) -> DataFrame:
    """The k best of each query, ranked from 1: highest score first, ties to the smaller vec_id."""
    once = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
