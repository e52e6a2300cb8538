"""Language identification: held-out accuracy, gradients, odd texts."""

import zlib

import numpy as np
from tests.llm.conftest import SAMPLE

from tallyhouse.llm import language

SCHEMA = "doc_id long, text string, lang string, source string"


def test_held_out_accuracy(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identified(documents, ["doc_id", "lang"]).collect()
    held = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 100 and np.mean([r.lang == r.lang_pred for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_odd_texts(table):
    taught = [(i, t, lang, None) for i in range(60) for lang, t in (("aa", "lorem ipsum dolor " * 3), ("bb", "żółw ćma źle " * 3))]
    odd = [(-1, None, "aa", None), (-2, "", "aa", None), (-3, "12 34 !?", "bb", None), (-4, "LOREM IPSUM DOLOR", None, None), (-5, "żółw " * 100_000, None, "s"),
           (None, "ćma", "bb", None), (-6, "x", None, None)]
    found = {r.doc_id: r for r in language.identified(table(SCHEMA, taught + odd + [odd[3]]), ["doc_id"]).collect()}
    assert [(found[i].lang_pred, found[i].score) for i in (-1, -2, -3)] == [("und", 0.0)] * 3
    assert found[-4].lang_pred == "aa" and found[-5].lang_pred == "bb" and found[None].lang_pred == "bb"
    assert found[-6].lang_pred in ("aa", "bb")


def test_repeated_ids_teach_once(table):
    repeated = [(1, f"word number {i} of many", "aa", None) for i in range(200)] + [(i, f"other {i}", "aa", None) for i in range(2, 6)]
    found = language.training_windows(table(SCHEMA, repeated), documents=5).collect()
    assert len(found) == len({bytes(r.window) for r in found}) == 5


def test_nothing_to_learn(table):
    assert language.identified(table(SCHEMA, []), ["doc_id"]).collect() == []
    found = language.identified(table(SCHEMA, [(1, "text", None, None)]), ["doc_id"]).collect()
    assert [tuple(r) for r in found] == [(1, "und", 0.0)]


def test_only_learned_from_the_rest(spark):
    documents = spark.read.parquet(f"{SAMPLE}/documents.parquet")
    held = {r.doc_id for r in documents.where(language.held_out()).select("doc_id").collect()}
    assert held == {r.doc_id for r in documents.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}


def test_windows_cover_every_place():
    for n in (0, 1, 255, 256, 257, 509, 510, 5000):
        data = bytes(i % 251 for i in range(n))
        rows = language.windows(data)
        seen = {i * language.STEP + j for i in range(len(rows)) for j in range(language.WINDOW) if rows[i, j] != language.PAD}
        assert seen == set(range(n))
        wide = {(i * language.STEP + j) for i in range(len(rows)) for j in range(language.STEP)}
        assert set(range(max(0, n - 3))) <= wide


def test_training_lowers_the_error():
    rng = np.random.default_rng(0)
    codes = rng.integers(97, 110, (200, language.WINDOW)).astype(np.int16)
    labels = np.arange(200) % 2
    codes[labels == 1, 40:44] = [120, 121, 122, 120]
    net = language.trained(codes, labels, ["a", "b"], epochs=60)  # four steps each
    assert (net.probabilities(codes).argmax(axis=1) == labels).mean() > 0.95
