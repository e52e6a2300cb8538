"""Phrase collocations against a plain count, Misra-Gries guarantees, long texts and odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from tests.llm.conftest import SAMPLE

from tallyhouse.llm import phrases

SCHEMA = "doc_id long, text string, lang string"
OUT = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, threshold=10, top=2000):
    counts, totals = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in (1, 2, 3):
                counts.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    candidates = {k: f for k, f in counts.items() if len(k[1]) > 1 and f >= threshold}
    out = []
    for (lang, words), a in candidates.items():
        cuts = [(1_000_000 * a * a // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        longer = [f for (other, w), f in candidates.items() if other == lang and len(w) > len(words) and any(w[i : i + len(words)] == words for i in range(len(w)))]
        if not any(100 * f >= 50 * a for f in longer):
            out.append((lang, -score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]]))
    found = []
    for lang in {o[0] for o in out}:
        own = sorted(o for o in out if o[0] == lang)[:top]
        found += [(lang, i + 1, p.decode(), -a, l, r, totals[lang], -s) for i, (_, s, a, p, l, r) in enumerate(own)]
    return sorted(found, key=repr)


def test_sample_equals_plain(spark, rows):
    documents = spark.read.parquet(f"{SAMPLE}/documents.parquet").select("doc_id", "text", "lang")
    expected = plain([tuple(r) for r in documents.collect()])
    assert len(expected) > 20 and rows(phrases.collocations(documents), *OUT) == expected


def test_odd_rows(table, rows):
    base = [(1, "New  York\tcity, New York. new york city" * 4, "en"), (1, "New  York\tcity, New York. new york city" * 4, "en"), (2, None, "en"), (3, "", None), (None, "a b " * 30, None),
            (4, "a b", "und"), (5, "Été d Été d\x0bA b x;" * 20, "fr"), (6, "one", "de"), (7, ".,;:!?\n \t", "es"), (8, "x" * 5000 + " y z " * 2000, "es"), (9, "q q q q " * 10, "")]
    assert rows(phrases.collocations(table(SCHEMA, base, clash=("phrase", "size", "rank", "f", "chunk", "_longer"))), *OUT) == plain(base)


@pytest.mark.parametrize("rows_", [[], [(1, None, None)], [(1, " .. ", "en")], [(1, "only one phrase", "en")]])
def test_nothing_to_find(table, rows_):
    assert phrases.collocations(table(SCHEMA, rows_)).collect() == []


def test_small_partitions_chunks_and_ties(table, rows, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 300)
    rng = random.Random(5)
    made = [(i, " ".join(rng.choice("abcdefghij") + rng.choice(["", "", ".", ","]) for _ in range(rng.randrange(1, 90))), rng.choice(["x", "y", None])) for i in range(120)]
    expected = plain(made, threshold=4, top=9)
    assert rows(phrases.collocations(table(SCHEMA, made), threshold=4, top=9, mass=500), *OUT) == expected
    assert max(r[1] for r in expected) == 9


def test_a_third_of_all_rows_alike(table, rows):
    made = [(0, "the same old words again and again", "en")] * 400 + [(i, f"word{i % 40} word{i % 7} the same", "en") for i in range(800)]
    assert rows(phrases.collocations(table(SCHEMA, made), mass=2000), *OUT) == plain(made)


def test_products_beyond_64_bits(spark):
    big = 4_000_000_000_000_000
    counts = spark.createDataFrame([("en", 0, "", big * 4), ("en", 1, "a", big), ("en", 1, "b", big - 3), ("en", 1, "c", 12), ("en", 2, "a b", big - 7), ("en", 2, "b c", 12), ("en", 3, "a b c", 12)],
                                   "lang string, size int, phrase string, f long")
    found = {r.phrase: (r.a, r.l, r.r, r.score) for r in phrases.scored(counts).collect()}
    assert found["a b"] == (big - 7, big, big - 3, 1_000_000 * (big - 7) ** 2 // (big * (big - 3)))
    assert found["a b c"] == (12, big, 12, 0) and "b c" not in found  # both cuts give 0: the first one


def test_frequent_keys_survive_every_merge():
    rng = np.random.default_rng(2)
    for threshold in (3, 10, 50):
        stream = rng.zipf(1.3, 20_000).astype(np.uint64).clip(max=1 << 31).astype(np.uint32)
        true = Counter(stream.tolist())
        capacity = len(stream) // threshold + 1
        merged = phrases.Summary(capacity)
        for part in np.array_split(stream, 37):
            own = phrases.Summary(capacity)
            own.add(*phrases.totals(part))
            merged.merge(own)
        left = set(merged.reaching(threshold).tolist())
        assert {k for k, f in true.items() if f >= threshold} <= left
        assert len(merged.keys) <= capacity and merged.lost < threshold
        assert all(f - merged.lost <= true[k] and f <= true[k] <= f + merged.lost for k, f in zip(merged.keys.tolist(), merged.counts.tolist(), strict=True))


def test_cut_texts_keep_every_phrase():
    rng = random.Random(1)
    for size in (12, 40, 200):
        text = phrases.normalized("".join(rng.choice(["a", "bb", "c" * rng.randrange(1, 30), " ", " ", ".", "\n", "é"]) for _ in range(600)).encode())

        def counted(segments):
            found = Counter()
            buffer = phrases.Buffer("en", segments)
            for n, first, keys in buffer.grams(5):
                found.update(zip(phrases.Buffer.phrases(buffer, first, n).to_pylist(), keys.tolist(), strict=True))
            return found, buffer.words()

        whole = counted([(0, text)])
        assert counted(list(phrases.cut(text, size))) == whole
        apart = [counted([s]) for s in phrases.cut(text, size)]
        assert sum((c for c, _ in apart), Counter()) == whole[0] and sum(n for _, n in apart) == whole[1]


def test_words_and_hashes():
    text = phrases.normalized(b"Ab  cd\tAB.ab,\xc3\x89x ab")
    starts, ends, piece = phrases.words_of(text)
    assert [text[a:b] for a, b in zip(starts, ends, strict=True)] == [b"ab", b"cd", b"ab", b"ab", b"\xc3\x89x", b"ab"] and piece.tolist() == [0, 0, 0, 1, 2, 2]
    hashes = phrases.word_hashes(text, starts, ends).tolist()
    assert hashes[0] == hashes[2] == hashes[3] == hashes[5] and len(set(hashes)) == 3
