"""Sharding by fixed virtual slots: records hash into slots, a versioned table says which shard a slot belongs to.

A record's virtual slot depends on the record, and among equal records on its number. The slots' bytes are summed, the heaviest slots are dealt first, each to
the lightest shard, and the map is stored under a version number. Rebalancing writes a new version with some slots moved; no
record is hashed anew. Groups of equal texts are not kept together: under the law `bytes` the sizes of shards come first. Only
DataFrame operations are used. The map has one row per virtual slot, a fixed number, so it may be
broadcast whatever the size of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SLOTS = 4096
SHARDS = 16
PARTS = 16  # of a slot, for numbering
RUN = 1 << 16  # copies of a row that are unfolded at once

SLOT, SHARD = "_virtual_slot", "_shard"


def record_size(text: str) -> Column:
    """UTF-8 bytes of the text (none if null) and one more for the record."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def virtual_slot(*columns: Column, slots: int = SLOTS) -> Column:
    """A fixed function of the given columns; nulls hash like other values."""
    return F.pmod(F.xxhash64(*columns), F.lit(slots)).cast("int")


def slot_totals(slotted: DataFrame, size: str, slots: int = SLOTS) -> DataFrame:
    """Bytes and rows of every virtual slot, empty ones included."""
    spark = slotted.sparkSession
    found = slotted.groupBy(SLOT).agg(F.sum(size).alias("bytes"), F.count("*").alias("rows"))
    every = spark.range(slots).select(F.col("id").cast("int").alias(SLOT))
    return every.join(found, SLOT, "left").select(SLOT, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("bytes", "rows")))


def _dealt(slots: Column, loads: Column, to: Column) -> Column:
    """Slots (structs of bytes and slot, in this order) as an array of (slot, shard), each given to the least loaded shard of `to`.

    `loads` has the bytes of every shard before the first slot is dealt.
    """
    start = F.struct(loads.alias("loads"), F.array().cast("array<struct<slot:int,shard:int>>").alias("made"))

    def deal(state: Column, slot: Column) -> Column:
        lightest = F.array_min(F.transform(to, lambda s: F.struct(F.get(state["loads"], s).alias("load"), s.alias("shard"))))["shard"]
        return F.struct(
            F.transform(state["loads"], lambda load, i: load + F.when(i == lightest, slot["bytes"]).otherwise(0)).alias("loads"),
            F.concat(state["made"], F.array(F.struct(slot["slot"].alias("slot"), lightest.alias("shard")))).alias("made"),
        )

    return F.aggregate(slots, start, deal, lambda state: state["made"])


def _entry() -> Column:
    """Sorts the heaviest slots first."""
    return F.struct((-F.col("bytes")).alias("minus"), F.col(SLOT).alias("slot"), F.col("bytes").alias("bytes"))


def slot_map(totals: DataFrame, shards: int = SHARDS, version: int = 1) -> DataFrame:
    """(version, virtual slot, shard): heaviest slots first, each to the shard with the fewest bytes, ties to the lower shard."""
    zero = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.lit(0).cast("long"))
    made = _dealt(F.col("slots"), zero, F.sequence(F.lit(0), F.lit(shards - 1)))
    one = totals.agg(F.array_sort(F.collect_list(_entry())).alias("slots")).select(F.explode(made).alias("m"))
    return one.select(F.lit(version).alias("version"), F.col("m.slot").alias(SLOT), F.col("m.shard").alias(SHARD))


def rebalanced(current: DataFrame, totals: DataFrame, shards: int) -> DataFrame:
    """The next version of a map for `shards` shards, moving few slots.

    Shards keep their slots, lightest first, up to the even share of bytes; what lies above, and the slots of shards
    that are gone, is dealt anew to the shards below it. With one more shard, slots move into that shard mostly, and records
    outside the moved slots keep their place.
    """
    everything = W.partitionBy()  # as many rows as there are virtual slots
    before = W.partitionBy(SHARD).orderBy("bytes", SLOT).rowsBetween(W.unboundedPreceding, 0)
    placed = totals.join(F.broadcast(current), SLOT).withColumn("filled", F.sum("bytes").over(before))
    placed = placed.withColumn("share", F.sum("bytes").over(everything) / shards)
    stays = (F.col(SHARD) < shards) & (F.col("filled") <= F.col("share"))
    placed = placed.withColumn("stays", stays).withColumn("version", F.max("version").over(everything) + 1)
    kept = placed.where("stays").select("version", SLOT, SHARD)
    one = placed.agg(
        F.array_sort(F.collect_list(F.when(~F.col("stays"), _entry()))).alias("slots"),
        F.collect_list(F.when(F.col("stays"), F.struct(SHARD, "bytes"))).alias("held"),
        F.max("version").alias("version"),
    )
    every = F.sequence(F.lit(0), F.lit(shards - 1))
    held = F.transform(every, lambda s: F.aggregate(F.filter("held", lambda h: h[SHARD] == s), F.lit(0).cast("long"), lambda sum_, h: sum_ + h["bytes"]))
    dealt = one.select("version", F.explode(_dealt(F.col("slots"), held, every)).alias("m"))
    return kept.unionByName(dealt.select("version", F.col("m.slot").alias(SLOT), F.col("m.shard").alias(SHARD)))


def store_map(placement: DataFrame, path: str) -> None:
    """Adds a version to the stored maps. A folder per version, so that a repeated write replaces only itself."""
    version = placement.agg(F.max("version")).first()[0]
    if version is not None:
        placement.drop("version").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, the latest by default."""
    stored = spark.read.schema(f"{SLOT} int, {SHARD} int, version int").parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == version)


def numbered_copies(records: DataFrame, into: str, run: int = RUN) -> DataFrame:
    """The records with the number of each among those equal to it in every column, from 1.

    Equal rows are counted before they meet, so they are no hot key, and a row with very many copies is unfolded in runs that many tasks share.
    """
    names = [F.col(f"`{c}`") for c in records.columns]
    counted = records.groupBy(*names).agg(F.count("*").alias("_copies"))
    tasks = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = counted.where(F.col("_copies") <= run).select(*names, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias(into))
    runs = counted.where(F.col("_copies") > run).withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / run))))
    many = runs.repartition(tasks, "_run").withColumn(
        into, F.explode(F.sequence(F.col("_run") * run + 1, F.least(F.col("_copies"), (F.col("_run") + 1) * run))))
    return few.unionByName(many.select(*names, into))


def sharded(records: DataFrame, size: str, identity: list[str], path: str, shards: int = SHARDS, slots: int = SLOTS, parts: int = PARTS) -> DataFrame:
    """The records with `_shard` and their gapless `_position` in the shard (from 0).

    The columns `identity` and the number of a row among its copies decide the virtual slot, so equal rows, of which there may be very
    many, spread over slots and shards like others; rows that differ in other columns only share a slot. The map is stored
    under `path`. Other columns pass through; their names must not start with `_`. A null counts as a value of its own. No records: no rows.

    Positions follow from row counts of each slot's `parts` and a numbering inside a part, so no task sees more than a part's rows at a time.
    """
    key = [*(F.col(c) for c in identity), F.col("_copy")]
    slotted = numbered_copies(records, "_copy", RUN).withColumns({SLOT: virtual_slot(*key, slots=slots), "_part": F.pmod(F.xxhash64(F.lit(1), *key), F.lit(parts)).cast("int")})
    totals = slot_totals(slotted, size, slots)
    store_map(slot_map(totals, shards), path)
    placement = load_map(records.sparkSession, path)
    counts = slotted.groupBy(SLOT, "_part").agg(F.count("*").alias("rows"))  # a fixed number of rows at most
    first = F.sum("rows").over(W.partitionBy(SHARD).orderBy(SLOT, "_part").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.join(F.broadcast(placement), SLOT).select(SLOT, "_part", SHARD, F.coalesce(first, F.lit(0)).alias("_first"))
    inside = F.row_number().over(W.partitionBy(SLOT, "_part").orderBy(*identity, "_copy")) - 1
    placed = slotted.withColumn("_inside", inside).join(F.broadcast(starts), [SLOT, "_part"])
    return placed.withColumn("_position", F.col("_first") + F.col("_inside")).select(*records.columns, SLOT, "_copy", SHARD, "_position")
