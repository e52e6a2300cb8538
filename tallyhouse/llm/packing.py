"""Packing token sequences into windows of a fixed length by Karmarkar-Karp multiway differencing.

A document's ids, with an end id, are cut into whole windows and parts of at most PART ids. A whole window is a sequence of its
own. The parts are dealt into groups of about GROUP windows' worth; a group is partitioned into as many windows as its ids need: partial
partitions, at first of one part each, are merged, always the two with the largest imbalance, heaviest windows of one with the
lightest of the other, until one is left. If a window is above the capacity, the number of windows rises by one. Groups are
bounded, so no task holds more than a group, whatever the size of the corpus or of a document.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.rows import beside, spread, with_row

CAPACITY = 2048
PART = 512
END = 1
GROUP = 256  # windows
BUNDLE = 64  # ids; shorter parts are packed together with others
SLICE = 128  # texts that are encoded before their pieces leave the task


def tokenized(documents: DataFrame, columns: list[str], path: str, text: str = "text", capacity: int = CAPACITY, part: int = PART, end: int = END) -> DataFrame:
    """A row per piece: the given columns, start, length, ids (binary, little-endian unsigned 32-bit) and doc_tokens.

    A null or empty text has the end id alone. Rows are documents, also repeated ones.
    """
    from tallyhouse.llm.tokens import Encoder

    told = beside(documents, columns, text=F.coalesce(F.col(text), F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = None, np.array([end], dtype="<u4").tobytes()
        for whole in batches:
            encoder = encoder or Encoder(path)
            for lo in range(0, whole.num_rows, SLICE):
                batch = whole.slice(lo, SLICE)
                row, start, length, ids, total = [], [], [], [], []
                for i, content in enumerate(batch.column(1)):
                    data = encoder.ids(content.as_py()) + last
                    n = len(data) // 4
                    edge = n - n % capacity
                    cuts = [*range(0, edge, capacity), *range(edge, n, part), n]
                    for a, b in zip(cuts, cuts[1:], strict=False):
                        row.append(i), start.append(a), length.append(b - a), ids.append(data[4 * a : 4 * b]), total.append(n)
                rows = pa.array(row, pa.int64())
                made = [batch.column(0).take(rows), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64())]
                yield pa.RecordBatch.from_arrays(made, ["row", "start", "length", "ids", "doc_tokens"])

    return spread(told.mapInArrow(run, with_row(told, "start long, length long, ids binary, doc_tokens long")))


def ids_crc32(ids: str = "ids") -> Column:
    return F.crc32(ids)


def differenced(sizes: np.ndarray, windows: int) -> list[list[int]]:
    """The items' numbers by window, for `windows` windows of nearly equal sums."""
    pairs: list[tuple[int, int]] = []  # a node n + i joins two nodes; nodes below n are items
    n = len(sizes)
    heap = [(-int(size), i, np.array([size]), np.array([i])) for i, size in enumerate(sizes)]  # a partition: sums, heaviest first, and nodes
    if windows == 1:
        return [list(range(n))]
    heapq.heapify(heap)
    made = n
    while len(heap) > 1:
        _, _, sums, nodes = heapq.heappop(heap)
        _, _, others, more = heapq.heappop(heap)
        over = len(sums) + len(others) - windows
        if over > 0:  # the lightest `over` windows of either meet, the heaviest with the lightest
            a, b = len(sums) - over, len(others) - over
            joint = sums[a:] + others[b:][::-1]
            new = np.arange(n + len(pairs), n + len(pairs) + over)
            pairs += zip(nodes[a:].tolist(), more[b:][::-1].tolist(), strict=True)
            sums, nodes = np.concatenate([sums[:a], others[:b], joint]), np.concatenate([nodes[:a], more[:b], new])
        else:
            sums, nodes = np.concatenate([sums, others]), np.concatenate([nodes, more])
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        if len(sums) == windows:
            sums = sums - sums[-1]
        heapq.heappush(heap, (-int(sums[0]), made, sums, nodes))
        made += 1
    found = []
    for root in heap[0][3].tolist() if heap else []:
        items, todo = [], [root]
        while todo:
            node = todo.pop()
            if node < n:
                items.append(node)
            else:
                todo += pairs[node - n]
        found.append(items)
    return found


def packed_group(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The window and the offset of every part. The windows are as few as differencing manages."""
    order = np.argsort(lengths, kind="stable")
    bundles, size = [], 0
    for i in order.tolist():  # parts below BUNDLE are joined to bundles of up to twice that
        if bundles and lengths[i] < BUNDLE and size + lengths[i] <= 2 * BUNDLE:
            bundles[-1].append(i)
            size += lengths[i]
        else:
            bundles.append([i])
            size = lengths[i]
    sizes = np.array([lengths[b].sum() for b in bundles], dtype=np.int64)
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        found = differenced(sizes, windows)
        if all(sizes[items].sum() <= capacity for items in found):
            break
        windows += 1
    window, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    for w, items in enumerate(found):
        at = 0
        for i in (i for item in items for i in bundles[item]):
            window[i], offset[i] = w, at
            at += lengths[i]
    return window, offset


def packed(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """The pieces, which must be a stored table, with sequence_id and offset; lengths are 1 to `capacity`. All other columns are kept.

    Parts go to groups by their place in the stored table, so equal rows do not meet in one group. No pieces: no rows.
    """
    row = F.monotonically_increasing_id()
    numbered = pieces.withColumn("_row", row)
    whole = numbered.where(F.col(length) == capacity)
    alone = whole.withColumns({"sequence_id": F.col("_row") + (1 << 62), "offset": F.lit(0).cast("long")}).drop("_row")
    parts = numbered.where(F.col(length) < capacity)
    total, rows = parts.agg(F.coalesce(F.sum(length), F.lit(0)), F.count("*")).first()
    groups = max(1, -(-total // (capacity * group)), rows >> 16)
    grouped = parts.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups))).drop("_row")
    columns = [c for c in pieces.columns]
    types = ", ".join(f"`{name}` {kind}" for name, kind in pieces.dtypes)

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        window, offset = packed_group(rows[length].to_numpy(), capacity)
        return rows[columns].assign(sequence_id=(int(key[0]) << 32) + window, offset=offset)

    shared = grouped.groupBy("_group").applyInPandas(pack, f"{types}, sequence_id long, offset long")
    return shared.unionByName(alone)
