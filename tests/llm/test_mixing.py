"""Targets, permutations, blocks and the mix."""

import math
import random
import re
from collections import Counter

import pytest

from pyspark.sql import functions as F
from tallyhouse.llm import mixing

SCHEMA = "doc_id long, source string, text string"


def plain_targets(sizes):
    """Excess is shared again and again until no target is above."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, full = {}, set()
    total = 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in full]
        left = total - sum(2 * sizes[s] for s in full)
        target = {s: 2.0 * sizes[s] if s in full else left * weight[s] / sum(weight[f] for f in free) for s in order}
        above = {s for s in free if target[s] > 2 * sizes[s]}
        if not above:
            return target
        full |= above


def corpus(seed, per_source):
    rng = random.Random(seed)
    return [(i, s, " ".join(rng.choices(["a", "bb", "é"], k=rng.randint(0, 400)))) for i, s in enumerate(s for s, n in per_source.items() for _ in range(n))]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


CASES = [{"a": 30, "b": 30, "c": 30}, {"a": 2, "b": 200, "c": 3, None: 10, "é": 1}, {"z": 5}, {"b": 100, "a": 1}]


@pytest.mark.parametrize("case", CASES)
def test_targets(table, case):
    documents = corpus(1, case)
    sizes = Counter()
    for _, s, t in documents:
        sizes[s] += len(words(t))
    frame = table(SCHEMA, documents).select("source", mixing.word_count("text").alias("size"))
    found = {r.source: (r.source_size, r.target) for r in mixing.source_targets(frame).collect()}
    expected = plain_targets(sizes)
    assert found.keys() == expected.keys()
    for s, (size, target) in found.items():
        assert size == sizes[s] and target == pytest.approx(expected[s], rel=1e-9)


@pytest.mark.parametrize("case", CASES)
def test_the_mix_keeps_targets_and_limits(table, case):
    documents = corpus(2, case) + [(9000, "a", None), (9001, "a", ""), (None, "a", "no id here"), (5, "a", "same row"), (5, "a", "same row")]
    frame = table(SCHEMA, documents).withColumn("size", mixing.word_count("text"))
    found = mixing.taken_words(frame, ["doc_id"]).collect()
    assert sorted(((r.doc_id, r.size) for r in found), key=repr) == sorted(((d, len(words(t))) for d, _, t in documents), key=repr)
    taken = Counter()
    for r in found:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for r in found:
        assert abs(taken[r.source] - r.target) <= 2 * mixing.BLOCK
    again = mixing.taken_words(frame.repartition(7, "text"), ["doc_id"]).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, again), key=repr)


def numbered(spark, sizes, key=5):
    """(n, x) for all x below each n, with what `permuted` needs."""
    each = spark.createDataFrame([(n,) for n in sizes], "n long").withColumn("pair", mixing.factors(F.col("n")))
    return each.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("key", F.lit(key).cast("long"))


def test_permutations_of_every_size(spark):
    there = mixing.permuted(numbered(spark, range(1, 1001)), "to", "x", "n", "pair", "key")
    back = mixing.permuted(there, "back", "to", "n", "pair", "key", inverse=True)
    found = back.groupBy("n").agg(F.count_distinct("to").alias("places"), F.min("to").alias("least"), F.max("to").alias("most"), F.sum((F.col("back") != F.col("x")).cast("int")).alias("wrong"),
                                  F.sum((F.col("to") == F.col("x")).cast("int")).alias("stay")).collect()
    assert len(found) == 1000 and all((r.places, r.least, r.most, r.wrong) == (r.n, 0, r.n - 1, 0) for r in found)
    assert all(r.stay < r.n / 8 for r in found if r.n >= 100)


@pytest.mark.parametrize("n", [1 << 20, (1 << 20) + 7, 1_299_709])
def test_large_permutations_spread(spark, n):
    """All places once, and neighbours far apart: steps between them are even over sixteen ranges."""
    to = [r.to for r in mixing.permuted(numbered(spark, [n]), "to", "x", "n", "pair", "key").orderBy("x").select("to").collect()]
    assert len(set(to)) == n and min(to) == 0 and max(to) == n - 1
    for distance in (1, 2, 1024):
        steps = Counter((b - a) % n * 16 // n for a, b in zip(to, to[distance:], strict=False))
        assert all(abs(c - n / 16) < 6 * math.sqrt(n / 16) for c in steps.values()) and len(steps) == 16
    first = Counter(t * 16 // n for t in to[: n // 16])
    assert all(abs(c - n / 256) < 6 * math.sqrt(n / 256) for c in first.values())


def test_factors_lie_close(spark):
    sizes = [1, 2, 3, 97, 1000, 10**6 + 3, 10**9 + 7, 10**12 + 39]
    for n, f in spark.createDataFrame([(n,) for n in sizes], "n long").select("n", mixing.factors(F.col("n")).alias("f")).collect():
        assert n <= f["a"] * f["b"] <= n + math.isqrt(n) + 1 and (n < 10 or f["b"] >= f["a"] / 4)


def test_keys_name_different_permutations(spark):
    every = [[r.to for r in mixing.permuted(numbered(spark, [500], key), "to", "x", "n", "pair", "key").orderBy("x").collect()] for key in range(4)]
    assert all(sum(a == b for a, b in zip(one, other, strict=True)) < 15 for i, one in enumerate(every) for other in every[:i])


def test_taken_words_equal_a_plain_mix(spark, table):
    """The plan's blocks laid over the streams by hand: every document gets the words of its blocks, as often as the plan uses them."""
    documents = corpus(7, {"a": 40, "b": 15, None: 6}) + [(5, "a", "same row"), (5, "a", "same row")]
    frame = table(SCHEMA, documents).withColumn("size", mixing.word_count("text"))
    found = mixing.taken_words(frame, ["doc_id"])
    targets = mixing.source_targets(frame)
    uses = Counter((r.source, r.block) for r in mixing.slots(targets).collect())
    hashed = frame.groupBy("doc_id", "source", "size").agg(F.count("*").alias("c")).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "c")))
    ordered = hashed.withColumn("bucket", F.xxhash64("doc_id", "size", "_copy").bitwiseAND(mixing.BUCKETS - 1)).collect()
    place, expected = Counter(), []
    for r in sorted(ordered, key=lambda r: (r.source or "", r.bucket, r.doc_id, r.size, r._copy)):
        words_ = range(place[r.source], place[r.source] + r.size)
        place[r.source] += r.size
        expected.append((r.doc_id, r.size, sum(uses[r.source, w // mixing.BLOCK] for w in words_)))
    assert sorted((r.doc_id, r.size, r.taken) for r in found.collect()) == sorted(expected)


def test_slots_use_blocks_evenly(spark):
    targets = spark.createDataFrame([("a", 1000, 2000.0), ("b", 6400, 3000.0), (None, 10, 20.0)], "source string, source_size long, target double")
    plan = mixing.slots(targets, shard=16).collect()
    uses = {}
    for r in plan:
        uses.setdefault(r.source, Counter())[r.block] += 1
    assert uses["a"] == {b: 2 for b in range(16)} and uses[None] == {0: 2}
    assert sum(uses["b"].values()) == round(3000 / 64) and set(uses["b"].values()) == {1} and max(uses["b"]) < 100
    assert sorted((r.output_shard, r.slot) for r in plan) == [(i // 16, i % 16) for i in range(len(plan))]
    counts = {(r.output_shard, r.source): r.slots for r in mixing.shard_counts(mixing.slots(targets, shard=16)).collect()}
    assert sum(counts.values()) == len(plan) and len({counts.get((s, "b"), 0) for s in range(5)}) > 1


@pytest.mark.parametrize("case", CASES[:2])
def test_the_mix_as_documents(table, case):
    """Every document's words come as often as `taken_words` says; whole passes keep the text."""
    documents = corpus(3, case) + [(9000, "a", None), (9001, "b", "  "), (None, "a", "no\tid\nhere "), (5, "a", "same row"), (5, "a", "same row")]
    frame = table(SCHEMA, documents)
    found = mixing.mixed_documents(frame).collect()
    assert found and frame.columns == mixing.mixed_documents(frame).columns
    size, target, taken = Counter(), None, Counter()
    own = {}
    for d, s, t in documents:
        size[s] += len(words(t))
        own.setdefault((d, s), []).append(t)
    for r in found:
        taken[r.source] += len(words(r.text))
        assert any(set(words(r.text)) <= set(words(t)) and len(words(r.text)) <= len(words(t)) for t in own[r.doc_id, r.source])
    target = plain_targets(size)
    for s in target:
        assert abs(taken[s] - target[s]) <= 2 * mixing.BLOCK


def test_nothing_to_mix(table):
    empty = table(SCHEMA, [])
    assert mixing.taken_words(empty.withColumn("size", mixing.word_count("text")), ["doc_id"]).collect() == []
    assert mixing.mixed_documents(empty).collect() == []
    silent = table(SCHEMA, [(1, "a", None), (2, None, "")])
    found = mixing.taken_words(silent.withColumn("size", mixing.word_count("text")), ["doc_id"]).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in found) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
