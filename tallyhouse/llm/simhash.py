"""Near duplicates by SimHash fingerprints, found with covering locality-sensitive hashing (Pagh, 2016).

A fingerprint bit is set if it is set in over half of the hashes of the text's word shingles. Fingerprints that differ in
few bits are linked; documents in one component are near duplicates. For a radius r there are 2^(r+1) - 1 bit masks such that any two
fingerprints within r agree under one of them at least: bit i has a vector m(i) of r + 1 bits, mask v keeps the bits with
an odd number of common ones in v and m(i), and r equations leave a v that keeps none of r differing bits.

Equal fingerprints are one node. A bucket (fingerprints equal under a mask) of up to BUCKET is compared in one task, which
returns the links of a spanning forest and not all pairs. A larger bucket is split by masks built the same way over the bits left, which
again lose no pair within the radius; after three levels at most 2^8 fingerprints are left. No bucket is cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.components import roots
from tallyhouse.llm.rows import beside, with_row
from tallyhouse.llm.storage import saved

SHINGLE = 3  # words
RADIUS = 3  # bits
HASH_SEED = 42
BUCKET = 512
BITS = 64
CHUNK = 1 << 14  # shingles whose bits are spread out at once


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text as a signed 64-bit number. Words lie between blanks, tabs and line ends; A-Z are lowered."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=HASH_SEED), shingles), dtype="<u8", count=n).view(np.uint8).reshape(n, 8)
    ones = sum(np.unpackbits(hashes[i : i + CHUNK], axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for i in range(0, n, CHUNK))
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(documents: DataFrame, columns: list[str], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """`row`, the given columns of every document, and `fingerprint`. A null or empty text has fingerprint 0."""
    kept = beside(documents, columns, text=F.coalesce(F.col(text), F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([fingerprint(t.as_buffer().to_pybytes(), shingle) for t in batch.column(1).cast(pa.binary())], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["row", "fingerprint"])

    return kept.mapInArrow(run, with_row(kept, "fingerprint long"))


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def covering_masks(kept: int = 0, radius: int = RADIUS) -> list[int]:
    """`kept` and half of the other bits, in 2^(radius+1) - 1 ways: other bit number i has the vector i mod 2^(radius+1)."""
    others = [bit for bit in range(BITS) if not kept >> bit & 1]
    kinds = 1 << (radius + 1)
    return [kept | sum(1 << bit for i, bit in enumerate(others) if (i % kinds & v).bit_count() % 2) for v in range(1, kinds)]


def _buckets(prints: DataFrame, masks: Column) -> DataFrame:
    return prints.withColumn("mask", F.explode(masks)).withColumn("key", F.col("fingerprint").bitwiseAND(F.col("mask")))


def forest(prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same prints as all pairs within the radius do: from each print to the first of its component."""
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= radius
    first = np.arange(len(prints))
    while True:
        lower = np.where(near, first[None, :], len(prints)).min(axis=1)
        lower = lower[lower]
        if (lower == first).all():
            break
        first = lower
    joined = first != np.arange(len(prints))
    return prints[joined], prints[first[joined]]


def _compared(buckets: DataFrame, radius: int) -> DataFrame:
    """The links inside buckets; each has BUCKET fingerprints at most."""
    grouped = buckets.groupBy("mask", "key").agg(F.collect_list("fingerprint").alias("prints")).select("prints")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [forest(np.array(p.as_py(), dtype=np.int64).view(np.uint64), radius) for p in batch.column(0)]
            if pairs:
                one, other = (np.concatenate([p[i] for p in pairs]).view(np.int64) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(other)], ["a", "b"])

    return grouped.mapInArrow(run, "a long, b long")


def links(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that join the distinct fingerprints as all pairs within the radius do."""
    spark = prints.sparkSession
    masks = [0]
    level, found, last = None, [], False
    while not last:
        finer = {m: covering_masks(m, radius) for m in masks}
        if level is None:
            rows = _buckets(prints, F.array(*(F.lit(_signed(m)) for m in finer[0])))
        else:
            table = spark.createDataFrame([(_signed(m), [_signed(f) for f in fs]) for m, fs in finer.items()], "mask long, finer array<long>")
            rows = _buckets(level.join(F.broadcast(table), "mask").drop("mask", "key"), F.col("finer")).drop("finer").distinct()
        masks = sorted({m for fs in finer.values() for m in fs})
        last = all(1 << (BITS - m.bit_count()) <= bucket for m in masks)
        sizes = rows.groupBy("mask", "key").agg(F.count("*").alias("size")).where("size > 1")
        shared = saved(rows.join(sizes, ["mask", "key"]), "buckets")
        found.append(_compared(shared if last else shared.where(F.col("size") <= bucket), radius))
        level = shared.where(F.col("size") > bucket).select("fingerprint", "mask", "key")
        last = last or level.isEmpty()
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return every


def rooted_duplicates(documents: DataFrame, columns: list[str] | None = None, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, the other given columns, fingerprint, component_id, the smallest doc_id of the component, and component_root, for every row.

    Rows equal in all columns stay apart and share a component, as do all rows without words. Null ids count only where a component
    has no other, so component_id may be null, and components that share an id may share it. component_root, a fingerprint of the
    component, names it: it is never null and no other component has it. No documents: no rows.
    """
    columns = ["doc_id", *(columns or [])]
    prints = saved(fingerprints(documents, columns, shingle=shingle), "fingerprints")
    nodes = saved(prints.groupBy("fingerprint").agg(F.min("row.doc_id").alias("least")), "distinct-fingerprints")
    joined = roots(links(nodes.select("fingerprint"), radius))
    placed = nodes.join(joined, nodes["fingerprint"] == joined["node"], "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    placed = saved(placed, "placed-fingerprints")
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    component = placed.join(smallest, "root").select("fingerprint", "component_id", F.col("root").alias("component_root"))
    return prints.join(component, "fingerprint").select("row.*", "fingerprint", "component_id", "component_root")


def near_duplicates(documents: DataFrame, columns: list[str] | None = None, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """`rooted_duplicates` without the root."""
    return rooted_duplicates(documents, columns, shingle, radius).drop("component_root")


def hexadecimal(column: str) -> Column:
    """A fingerprint as 16 hexadecimal digits."""
    return F.lpad(F.lower(F.hex(column)), 16, "0")
