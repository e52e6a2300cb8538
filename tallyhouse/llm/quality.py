"""Quality of texts by histogram gradient-boosted trees over document statistics.

A text's statistics are shares and means: kinds of characters, word lengths, capitals, repeated words, pairs of words and lines, entropy. They are
taken over the whole text, in blocks of BLOCK characters whose values are averaged by length, so memory does not grow with a text.

Training is numpy on the driver over a bounded sample of labelled documents: those TRAIN_DOCUMENTS with the lowest hashes of doc_id. Every
statistic is cut into BINS at its quantiles; a tree grows level by level, and the gradient and hessian histograms of a level's nodes
give its best cuts (log loss, second order). Trees are complete and lie in flat arrays; a batch of documents walks all trees at
once, one level a step.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.language import held_out
from tallyhouse.llm.rows import beside, spread, with_row

TRAIN_DOCUMENTS = 20_000
BLOCK = 1 << 17  # characters
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.15
SHRINK = 1.0  # added to a leaf's hessian
LEAST = 5  # documents of a leaf
BATCH = 512  # documents that walk the trees at once
KEEP = 0.3

LETTERS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r\x0b\x0c", ".", ",;:", "!?", "'\"()[]{}", "#$%&*@^~_=+", "|/\\<>", "-")
_KIND = np.full(256, len(LETTERS), dtype=np.uint8)  # a byte beyond ASCII, or any other
for _i, _kind in enumerate(LETTERS):
    _KIND[list(_kind.encode())] = _i

STATISTICS = (
    *(f"share_of_kind_{i}" for i in range(len(LETTERS) + 1)), "entropy", "word_length", "word_spread", "longest_word", "short_words", "lettered_words", "upper_words", "title_words",
    "distinct_words", "most_common_word", "same_as_before", "distinct_pairs", "line_length", "distinct_lines", "words_a_line", "log_length",
)


def _block(text: str) -> list[float]:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    by_byte = np.bincount(raw, minlength=256)
    kinds = np.bincount(_KIND, weights=by_byte, minlength=len(LETTERS) + 1) / max(1, len(raw))
    seen = by_byte[by_byte > 0] / max(1, len(raw))
    words, lines = text.split(), text.splitlines() or [""]
    n = max(1, len(words))
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    return [
        *kinds, float(-(seen * np.log2(seen)).sum()), float(sizes.mean()), float(sizes.std()), float(np.log1p(sizes.max())), float((sizes <= 3).mean()),
        sum(map(str.isalpha, words)) / n, sum(map(str.isupper, words)) / n, sum(map(str.istitle, words)) / n,
        len(set(words)) / n, max(Counter(words).values(), default=0) / n, sum(map(operator.eq, words, words[1:])) / n, len(set(zip(words, words[1:], strict=False))) / n,
        float(np.log1p(len(text) / len(lines))), len(set(lines)) / len(lines), float(np.log1p(n / len(lines))),
    ]


def statistics(text: str | None) -> list[float]:
    """The STATISTICS of a text; a null one is empty."""
    text = text or ""
    blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)] or [""]
    mean = np.average([_block(b) for b in blocks], axis=0, weights=[len(b) or 1 for b in blocks])
    return [*mean.tolist(), float(np.log1p(len(text)))]


@dataclass
class Forest:
    """Complete trees: node i has the children 2i + 1 and 2i + 2. A document goes to the second one if its value is above the node's cut."""

    base: float
    feature: np.ndarray  # (tree, inner node)
    cut: np.ndarray  # (tree, inner node)
    leaf: np.ndarray  # (tree, leaf)

    def scores(self, values: np.ndarray) -> np.ndarray:
        """The probability of label 1 for rows of statistics."""
        found = np.empty(len(values))
        trees, inner = np.arange(len(self.leaf)), self.feature.shape[1]
        for lo in range(0, len(values), BATCH):
            part = values[lo : lo + BATCH]
            rows = np.arange(len(part))[:, None]
            node = np.zeros((len(part), len(trees)), dtype=np.int64)
            while inner and node[0, :1].size and node[0, 0] < inner:
                node = 2 * node + 1 + (part[rows, self.feature[trees, node]] > self.cut[trees, node])
            found[lo : lo + BATCH] = self.base + self.leaf[trees, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(found, -500, 500)))


def binned(values: np.ndarray, bins: int = BINS) -> tuple[np.ndarray, list[np.ndarray]]:
    """The number of each value's bin, and the upper cuts of each statistic's bins."""
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for column in values.T]
    return np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, values.T, strict=True)], axis=1), cuts


def trained(values: np.ndarray, labels: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Forest:
    """A forest fitted to rows of statistics and labels 0 and 1. With one label only there are no trees, and the score is near that label."""
    n, width = values.shape
    positive = (labels.sum() + 0.5) / (n + 1)
    base = float(np.log(positive / (1 - positive)))
    inner = (1 << depth) - 1
    if labels.min() == labels.max():
        trees = 0
    codes, cuts = binned(values, bins)
    flat = codes + np.arange(width) * bins
    feature, cut, leaf = np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    margin = np.full(n, base)
    for tree in range(trees):
        guess = 1 / (1 + np.exp(-margin))
        gradient, hessian = guess - labels, guess * (1 - guess)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, nodes = (1 << level) - 1, 1 << level
            place = ((node - first) * width * bins)[:, None] + flat
            histogram = [np.bincount(place.ravel(), weights=np.repeat(w, width), minlength=nodes * width * bins).reshape(nodes, width, bins)
                         for w in (gradient, hessian, np.ones(n))]
            below = [h.cumsum(axis=2) for h in histogram]
            total = [b[:, :, -1:] for b in below]
            gain = (below[0] ** 2 / (below[1] + SHRINK) + (total[0] - below[0]) ** 2 / (total[1] - below[1] + SHRINK) - total[0] ** 2 / (total[1] + SHRINK))
            gain[(below[2] < LEAST) | (total[2] - below[2] < LEAST)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            use = gain.reshape(nodes, -1).max(axis=1) > 1e-9
            chosen, at = best // bins, best % bins
            for i in np.flatnonzero(use):
                feature[tree, first + i], cut[tree, first + i] = chosen[i], cuts[chosen[i]][at[i]]
            own = node - first
            node = 2 * node + 1 + (use[own] & (codes[np.arange(n), chosen[own]] > at[own]))
        g = np.bincount(node - inner, weights=gradient, minlength=inner + 1)
        h = np.bincount(node - inner, weights=hessian, minlength=inner + 1)
        leaf[tree] = -rate * g / (h + SHRINK)
        margin += leaf[tree][node - inner]
    return Forest(base, feature, cut, leaf)


def _measured(rows: DataFrame) -> DataFrame:
    """(row, statistics) for rows of (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], ["row", "statistics"])

    return rows.mapInArrow(run, with_row(rows, "statistics array<double>"))


def training_rows(documents: DataFrame, labels: DataFrame, at_most: int = TRAIN_DOCUMENTS) -> DataFrame:
    """(row, label, statistics): up to `at_most` labelled documents that are not held out, those with the lowest hashes of doc_id.

    `labels` has doc_id and label; labels other than 0 and 1 teach nothing, a document with both teaches both. Of several texts with one
    id the one with the lowest hash is read. Ids are chosen before texts are read.
    """
    told = labels.where("doc_id is not null and label in (0, 1)").where(~held_out()).select("doc_id", F.col("label").cast("int").alias("label")).distinct()
    present = told.join(documents.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_semi").withColumn("_at", F.xxhash64("doc_id"))
    share = min(1.0, 2 * at_most / max(1, present.count()))  # so that few more than needed are put in order
    few = present.where(F.lit(share) >= F.shiftrightunsigned("_at", 11) / float(1 << 53)).orderBy("_at", "doc_id", "label").limit(at_most).drop("_at")
    ids = F.broadcast(few.select("doc_id").distinct())  # `at_most` at most
    texts = documents.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    measured = _measured(texts.select(F.struct("doc_id", F.xxhash64("text").alias("hash")).alias("row"), "text"))
    one = measured.groupBy(F.col("row.doc_id").alias("doc_id")).agg(F.min(F.struct("row.hash", "statistics")).alias("least"))
    return one.join(few, "doc_id").select("doc_id", "label", "least.statistics")


def learned(documents: DataFrame, labels: DataFrame, at_most: int = TRAIN_DOCUMENTS) -> Forest | None:
    """The forest for labelled documents; none if no document teaches."""
    rows = sorted(tuple(r) for r in training_rows(documents, labels, at_most).collect())  # bounded by the sample
    if not rows:
        return None
    return trained(np.array([r[2] for r in rows]), np.array([float(r[1]) for r in rows]))


def scored(documents: DataFrame, forest: Forest | None, columns: list[str], text: str = "text") -> DataFrame:
    """The given columns of every document with `score`, the probability of label 1, and `predicted`, 1 from KEEP on.

    Null and empty texts are scored as texts without words. With nothing learned the score is 0.5. Repeated rows are scored alike. The columns
    may have any names but these two.
    """
    rows = beside(documents, columns, text=F.col(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([statistics(t.as_py()) for t in batch.column(1)]).reshape(batch.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forest.scores(found) if forest else np.full(batch.num_rows, 0.5))], ["row", "score"])

    told = rows.mapInArrow(run, with_row(rows, "score double"))
    return spread(told.withColumn("predicted", (F.col("score") >= KEEP).cast("int")))
