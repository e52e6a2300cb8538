"""Fingerprints, covering masks and components against plain versions."""

import random
import re
import string

import numpy as np
import pytest
import xxhash

from tallyhouse.llm import components, simhash

SCHEMA = "doc_id long, text string"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=3):
    """Ids by row: the smallest id that is reachable over links."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= radius and find(i) != find(j):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        known = least.get(find(i))
        least[find(i)] = doc if known is None else known if doc is None else min(known, doc)
    return [least[find(i)] for i in range(len(prints))]


def corpus():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(200)]
    base = [rng.choices(words, k=rng.randint(30, 300)) for _ in range(40)]
    near = []
    for own in base[:12]:
        for _ in range(6):
            edited = list(own)
            edited[rng.randrange(len(edited))] = "changed"
            near.append(edited)
    texts = [" ".join(w) for w in base + near]
    odd = ["", None, " \t\n", "One", "one two", "ONE TWO", "x\x0by z\x0cq r   s", "word " * 20_000, "ÉÀ é Z"]
    return [(i, t) for i, t in enumerate(texts + texts[:5] + odd)] + [(None, texts[0]), (3, texts[3]), (None, "alone")]


def test_equals_plain_version(table):
    documents = corpus()
    found = simhash.near_duplicates(table(SCHEMA, documents)).collect()
    prints = [(i, plain_fingerprint(t)) for i, t in documents]
    expected = [(i, p - (1 << 64) if p >> 63 else p, c) for (i, p), c in zip(prints, plain_components(prints), strict=True)]
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)


def test_every_pair_within_the_radius_meets_under_a_mask():
    masks = simhash.covering_masks()
    assert len(masks) == 15 and {m.bit_count() for m in masks} == {32}
    rng = random.Random(4)
    for _ in range(2000):
        differ = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(m & differ == 0 for m in masks)
    finer = simhash.covering_masks(masks[4])
    assert {m.bit_count() for m in finer} == {48}
    free = [b for b in range(64) if not masks[4] >> b & 1]
    for _ in range(500):
        differ = sum(1 << b for b in rng.sample(free, 3))
        assert any(m & differ == 0 for m in finer)


@pytest.mark.parametrize("bucket", [256, 512])
def test_large_buckets_are_split_without_loss(spark, bucket):
    """Some thousand fingerprints around one centre: buckets above the bound."""
    rng = random.Random(5)
    prints = sorted({sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(2500)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.links(spark.createDataFrame([(s,) for s in signed], "fingerprint long"), bucket=bucket)
    root = {r.node: r.root for r in components.roots(links).collect()}
    values = np.array(prints, dtype=np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3
    label = np.arange(len(values))
    while True:
        lower = np.where(near, label[None, :], len(values)).min(axis=1)
        if (lower == label).all():
            break
        label = lower
    groups = {}
    for s, g in zip(signed, label.tolist(), strict=True):
        groups.setdefault(g, []).append(s)
    for group in groups.values():
        assert {root.get(s, s) for s in group} == {min(group)}


def test_roots_of_a_long_chain_and_no_links(spark):
    chain = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(5, 5), (100, 101), (101, 100)], "x long, y long")
    assert {tuple(r) for r in components.roots(chain).collect()} == {(i, 0) for i in range(1, 61)} | {(101, 100)}
    assert components.roots(spark.createDataFrame([], "x long, y long")).collect() == []


def test_no_documents(table):
    assert simhash.near_duplicates(table(SCHEMA, [])).collect() == []


def test_a_star_with_very_many_links_is_split(spark):
    """One node with a third of all links: the joins by node are split, and the components are whole."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.shuffle.partitions": "16",
                "spark.sql.adaptive.forceOptimizeSkewedJoin": "true"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    links = spark.range(1, 6001).selectExpr("if(id <= 2000, 0L, id) as a", "if(id <= 2000, id, id + 10000L) as b").repartition(8)
    stars = components._stars(links.selectExpr("greatest(a, b) as a", "least(a, b) as b"))
    stars.collect()
    plan = stars._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    found = {r.node: r.root for r in components.roots(links).collect()}
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "skew=true" in plan
    assert found == {i: 0 for i in range(1, 2001)} | {i + 10000: i for i in range(2001, 6001)}
