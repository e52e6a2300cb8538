"""Virtual slots, maps and positions."""

import random

import pytest

from pyspark.sql import functions as F
from tallyhouse.llm import sharding
from tallyhouse.llm.storage import new_folder

SCHEMA = "doc_id long, text string"


def placed(spark, frame, path=None):
    records = frame.withColumns({"size": sharding.record_size("text"), "crc": F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")))})
    return sharding.sharded(records, "size", ["doc_id", "crc", "size"], path or new_folder(spark, "map")).collect()


def test_bytes_are_even_and_positions_gapless(spark, table):
    rng = random.Random(4)
    documents = [(i, "é" * rng.randint(0, 900)) for i in range(3000)] + [(9000, None), (9001, ""), (None, "a"), (None, "b"), (9002, "x" * 20_000), (4, "dup"), (4, "dup")]
    found = placed(spark, table(SCHEMA, documents, clash=()))
    assert sorted(((r.doc_id, r.text) for r in found), key=repr) == sorted(documents, key=repr)
    assert all(r.size == len((r.text or "").encode()) + 1 for r in found)
    sums = [sum(r.size for r in found if r._shard == s) for s in range(16)]
    assert max(sums) - min(sums) <= 0.01 * max(sums)
    for s in range(16):
        assert sorted(r._position for r in found if r._shard == s) == list(range(sum(r._shard == s for r in found)))


def test_a_new_shard_takes_few_slots_and_versions_stay(spark, table):
    frame = table(SCHEMA, [(i, "x" * (i % 700)) for i in range(4000)]).withColumn("size", sharding.record_size("text"))
    slotted = frame.withColumn(sharding.SLOT, sharding.virtual_slot(F.col("doc_id")))
    totals = sharding.slot_totals(slotted, "size")
    path = new_folder(spark, "maps")
    sharding.store_map(sharding.slot_map(totals, 16), path)
    first = {r[0]: r[1] for r in sharding.load_map(spark, path).select(sharding.SLOT, sharding.SHARD).collect()}
    sharding.store_map(sharding.rebalanced(sharding.load_map(spark, path), totals, 17), path)
    second = {r[0]: r[1] for r in sharding.load_map(spark, path).select(sharding.SLOT, sharding.SHARD).collect()}
    again = {r[0]: r[1] for r in sharding.load_map(spark, path, 1).select(sharding.SLOT, sharding.SHARD).collect()}
    assert first == again and set(first) == set(second) == set(range(sharding.SLOTS))
    size = {r[0]: r.bytes for r in totals.collect()}
    sums = [sum(b for s, b in size.items() if second[s] == k) for k in range(17)]
    assert max(sums) - min(sums) <= 0.02 * max(sums)
    moved = [s for s in first if first[s] != second[s]]
    assert sum(size[s] for s in moved) <= sum(size.values()) / 17 * 1.3


@pytest.mark.parametrize("documents", [[], [(None, None)]])
def test_few_documents(spark, table, documents):
    found = placed(spark, table(SCHEMA, documents, clash=()))
    assert [(r.doc_id, r.size, r._position) for r in found] == [(None, 1, 0)] * len(documents)


def plain_deal(sizes, shards):
    """slot -> shard: heaviest slots first, each to the shard with the fewest bytes, ties to the lower one."""
    loads, made = [0] * shards, {}
    for slot, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        made[slot] = min(range(shards), key=lambda s: (loads[s], s))
        loads[made[slot]] += size
    return made


@pytest.mark.parametrize("run", [7, 1 << 16])
def test_a_third_of_the_rows_alike(spark, table, monkeypatch, run):
    """Equal rows without an id spread over the shards; the map is a plain deal of the slots' bytes."""
    monkeypatch.setattr(sharding, "RUN", run)
    documents = [(None, "the same text of some length")] * 4000 + [(i, "x" * (i % 60)) for i in range(8000)] + [(5, "x" * 5)] * 3
    found = placed(spark, table(SCHEMA, documents, clash=()))
    assert sorted(((r.doc_id, r.text) for r in found), key=repr) == sorted(documents, key=repr)
    sums = [sum(r.size for r in found if r._shard == s) for s in range(16)]
    assert max(sums) <= 1.01 * sum(sums) / 16
    for s in range(16):
        assert sorted(r._position for r in found if r._shard == s) == list(range(sum(r._shard == s for r in found)))
    slots = dict.fromkeys(range(sharding.SLOTS), 0)
    for r in found:
        slots[r[sharding.SLOT]] += r.size
    deal = plain_deal(slots, 16)
    assert all(deal[r[sharding.SLOT]] == r._shard for r in found)
    alike = [r for r in found if r.doc_id is None]
    assert sorted(r._copy for r in alike) == list(range(1, 4001)) and len({r[sharding.SLOT] for r in alike}) > 2000
    again = placed(spark, table(SCHEMA, documents, clash=()).repartition(7))
    place = lambda rows: sorted(((r.doc_id, r.text, r._copy, r._shard, r._position) for r in rows), key=repr)
    assert place(again) == place(found)
