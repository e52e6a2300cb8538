"""Quality scores: held-out accuracy, boosted trees against a plain walk, odd texts and labels."""

import zlib

import numpy as np
import pytest

from tallyhouse.llm import quality, queries

SCHEMA = "doc_id long, text string, lang string"


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    found = queries.op12_quality(spark, folder).collect()
    assert len(found) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    held = [(r.predicted, labels[r.doc_id]) for r in found if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and np.mean([p == y for p, y in held]) >= 0.95


def walked(forest, row):
    margin = forest.base
    for feature, cut, leaf in zip(forest.feature, forest.cut, forest.leaf, strict=True):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
        margin += leaf[node - len(feature)]
    return 1 / (1 + np.exp(-margin))


def test_vectorised_walk_equals_a_plain_one():
    rng = np.random.default_rng(4)
    values = rng.normal(size=(700, 6)).round(1)
    labels = ((values[:, 0] > 0.3) ^ (values[:, 3] > 0)).astype(float)
    forest = quality.trained(values, labels)
    scores = forest.scores(values)
    assert np.allclose(scores, [walked(forest, row) for row in values]) and ((scores > 0.5) == labels).mean() > 0.97


def test_first_tree_takes_the_best_cut():
    values = np.array([[float(i), 5.0, float(i % 3)] for i in range(40)])
    labels = (values[:, 0] > 24).astype(float)
    forest = quality.trained(values, labels, trees=1, depth=1)
    gains = {}
    p = (labels.sum() + 0.5) / 41
    for j in range(3):
        for c in sorted(set(values[:, j])):
            low = values[:, j] <= c
            if quality.LEAST <= low.sum() <= 40 - quality.LEAST:
                gains[j, c] = sum((p - labels[m]).sum() ** 2 / (p * (1 - p) * m.sum() + quality.SHRINK) for m in (low, ~low))
    assert (forest.feature[0, 0], forest.cut[0, 0]) == max(gains, key=gains.get) == (0, 24.0)


def test_odd_texts_and_labels(table):
    good, bad = "The quick brown fox jumps over the lazy dog again. ", "###$$$ |||| @@@ "
    documents = [(i, (good if i % 2 else bad) * (1 + i % 5), None) for i in range(200)] + [(1, "another text", "en")] * 2
    documents += [(900, None, None), (901, "", None), (902, good * 20_000, None), (903, "é" * 10, None), (None, good, None), (904, "\n\r\n", "xx")]
    labels = [(i, i % 2) for i in range(150)] + [(1, 0), (3, None), (None, 1), (5, 7), (12345, 1), (900, 0)]
    told = table("doc_id long, label int", labels)
    found = [tuple(r) for r in quality.scored(table(SCHEMA, documents), quality.learned(table(SCHEMA, documents), told), ["doc_id", "text", "_text"]).collect()]
    assert len(found) == len(documents) and all(0 <= r[3] <= 1 and r[2] == "x" for r in found)
    by_id = {}
    for r in found:
        by_id.setdefault(r[0], []).append(r)
    assert all(by_id[i][0][4] == i % 2 for i in range(150, 200))
    assert by_id[902][0][4] == 1 and len(by_id[1]) == 3


def test_labels_teach_once_and_not_when_held_out(table):
    documents = [(i, f"text {i}", None) for i in range(60)] + [(2, "text 2", None)] * 30
    labels = [(i, i % 2) for i in range(60)] * 2
    rows = quality.training_rows(table(SCHEMA, documents), table("doc_id long, label int", labels)).collect()
    assert sorted((r.doc_id, r.label) for r in rows) == [(i, i % 2) for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    few = quality.training_rows(table(SCHEMA, documents), table("doc_id long, label int", labels), at_most=7).collect()
    assert len(few) == 7


@pytest.mark.parametrize("labels", [[], [(i, 1) for i in range(20)], [(1, None)]])
def test_too_few_labels(table, labels):
    documents = table(SCHEMA, [(i, "some text", None) for i in range(20)] + [(None, None, None)])
    forest = quality.learned(documents, table("doc_id long, label int", labels))
    found = {r.score for r in quality.scored(documents, forest, ["doc_id"]).collect()}
    assert len(found) == 1 and (found == {0.5} if len(labels) < 2 else min(found) > 0.9)


def test_no_documents(table):
    empty = table(SCHEMA, [])
    assert quality.scored(empty, quality.learned(empty, table("doc_id long, label int", [(1, 1)])), ["doc_id"]).collect() == []


def test_statistics_cover_whole_texts():
    assert len(quality.statistics("some text")) == len(quality.statistics(None)) == len(quality.STATISTICS)
    long = "calm words here. " * 30_000
    changed = quality.statistics(long + "$$$$ " * 30_000)
    assert changed[9] > 0.1 and quality.statistics(long)[9] == 0
