"""Removal of repeated strings against a plain version."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tallyhouse.llm import queries, suffixes

SCHEMA = "doc_id long, text string"
LENGTH = 48


def plain(documents, length=LENGTH):
    counts = Counter()
    for _, text in documents:
        data = (text or "").encode()
        counts.update(data[i : i + length] for i in range(len(data) - length + 1))
    out = []
    for doc, text in documents:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, dtype=int)
        for i in range(len(data) - length + 1):
            if counts[data[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.append(False, np.cumsum(gone[:-1]) > 0)
        edges = np.flatnonzero(np.diff(np.append(gone, False).astype(int)))
        spans = [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)]
        out.append((doc, bytes(b for b, g in zip(data, gone[1:], strict=True) if not g), spans))
    return sorted(out, key=repr)


def passages(seed, shared, copies):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choices("abcdefgh é\n", k=n))
    parts = [text(rng.randint(40, 160)) for _ in range(shared)]
    documents = []
    for _ in range(copies):
        own = [text(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            part = rng.choice(parts)
            cut = rng.randint(0, 20)
            own += [part[cut : len(part) - rng.randint(0, 20)], text(rng.randint(0, 90))]
        documents.append("".join(own))
    return documents


@pytest.mark.parametrize("most", [2, 6, 1024])
def test_equals_plain_version(table, most):
    """Small bounds send shared passages through the ranges of starts, large ones through the sorted classes."""
    texts = passages(7, 4, 90) + ["x" * 47, "x" * 48, "y" * 500, "ab" * 300, "", None, "é" * 30, "\x00" * 60]
    documents = list(enumerate(texts)) + [(3, texts[3]), (None, texts[5]), (None, "lonely " * 20), (5, "another text under a known id, long enough to be looked at")]
    found = suffixes.without_repeats(table(SCHEMA, documents), ["doc_id"], length=LENGTH, most=most)
    got = sorted(((r.doc_id, bytes(r.kept), [(s.start, s.end) for s in r.spans]) for r in found.collect()), key=repr)
    assert got == plain(documents)


def test_a_very_long_text(table):
    rng = random.Random(8)
    long = "".join(rng.choices("abcdefghijkl ", k=1_500_000))
    documents = [(0, long), (1, "head " + long[700_000:700_900] + " tail")]
    found = suffixes.without_repeats(table(SCHEMA, documents), ["doc_id"]).collect()
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in found}
    assert spans == {0: [(700_000, 700_900)], 1: [(5, 905)]}


def test_cut_characters_go_from_strings(table):
    shared = "é" * 40
    documents = [(0, "a" + shared + "b"), (1, "c" + shared + "dèe")]
    found = suffixes.without_repeats(table(SCHEMA, documents), ["doc_id"], length=LENGTH, as_text=True)
    assert {r.doc_id: r.kept for r in found.collect()} == {0: "ab", 1: "cdèe"}


def test_no_documents(table):
    assert suffixes.without_repeats(table(SCHEMA, []), ["doc_id"]).collect() == []


def test_quicksort_sorts():
    rng = np.random.default_rng(9)
    for n, k, high in [(0, 3, 5), (1, 1, 5), (500, 4, 3), (3000, 6, 2), (1000, 2, 10**9)]:
        keys = rng.integers(0, high, (n, k)).astype(np.uint64)
        assert [tuple(r) for r in keys[suffixes.multikey_quicksort(keys)]] == sorted(tuple(r) for r in keys)


def test_equal_strings_sample_the_same_place():
    rng = random.Random(10)
    common = bytes(rng.choices(range(97, 110), k=400))
    for _ in range(20):
        one, other = (bytes(rng.choices(range(97, 110), k=rng.randint(0, 700))) + common + bytes(rng.choices(range(97, 110), k=rng.randint(0, 700))) for _ in range(2))
        which, places = suffixes.sampled_places([one, other])
        at = [one.index(common), other.index(common)]
        inside = [{p - at[w] for w, p in zip(which, places, strict=True) if w == side and 0 <= p - at[w] <= 400 - suffixes.GRAM} for side in (0, 1)]
        assert inside[0] & inside[1]


def test_large_classes_are_not_shuffled_by_class(spark, monkeypatch):
    dealt = []
    solve = suffixes.class_spans
    monkeypatch.setattr(suffixes, "class_spans", lambda contexts, *rest: dealt.append(contexts) or solve(contexts, *rest))
    rows = [(c, f"{c}{i}".encode(), 1, n, b"p", b"r" * 32) for c, n in ((b"a", 3), (b"b", 50)) for i in range(n)]
    contexts = spark.createDataFrame(rows, "class binary, whole binary, n long, size long, prior binary, rest binary")
    found = suffixes._solved(contexts, 10, 400).collect()
    assert dealt[0].groupBy("class").count().collect() == [(bytearray(b"a"), 3)]
    assert sorted(bytes(r.whole) for r in found if r["class"] is not None) == sorted(r[1] for r in rows if r[0] == b"b")


def test_query_equals_brute_force_on_the_larger_sample(spark):
    """Every 400-byte string of every document by its 64-bit hash, and the bytes that repeated ones cover."""
    folder = "/root/testdata/sf0.01"
    texts = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    hashes = [[hash(data[i : i + 400]) for i in range(len(data) - 399)] for _, data in texts]
    counts = Counter(h for own in hashes for h in own)
    expected = []
    for (doc, data), own in zip(texts, hashes, strict=True):
        gone = np.zeros(len(data) + 1, dtype=np.int64)
        for i, h in enumerate(own):
            if counts[h] > 1:
                gone[i] += 1
                gone[i + 400] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(data, dtype=np.uint8)[~gone])
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
        expected.append((doc, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    found = [tuple(r) for r in queries.op4_suffixes(spark, folder).collect()]
    assert sorted(found) == sorted(expected) and sum(r[2] > 0 for r in found) > 50
