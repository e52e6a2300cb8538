"""Language identification by a convolutional network over bytes, trained here on labelled documents.

A text, lowered and as UTF-8, is cut into windows of a fixed length that overlap by the widest filter less one byte, so every
byte sequence a filter can see is seen. Bytes have learned vectors; filters of several widths run over a window, the maximum of each over
the window is kept, and a dense layer with softmax gives the languages. A document's probabilities are the mean of its windows',
weighted by their bytes. Training is numpy on the driver over a bounded sample: `TRAIN_DOCUMENTS` per language, `TRAIN_WINDOWS` windows
of each. Prediction covers every window of every text, in batches inside the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyhouse.llm.rows import beside, spread, with_row
from tallyhouse.llm.storage import saved

WINDOW = 256  # bytes
WIDTHS = (2, 3, 4)
FILTERS = 16  # of each width
VECTOR = 8  # numbers per byte
PAD = 256  # stands for no byte
TRAIN_DOCUMENTS = 400  # per language
TRAIN_WINDOWS = 4  # per document
EPOCHS = 8
FEW_IDS = 1 << 16  # that may be sent to every task
SEED = 11
BATCH = 128  # windows that go through the network at once
STEP = WINDOW - max(WIDTHS) + 1
UNKNOWN = "und"


def windows(data: bytes) -> np.ndarray:
    """All windows of a text as rows of byte numbers, the last one padded."""
    codes = np.frombuffer(data, dtype=np.uint8)
    n = max(1, -(-(len(codes) - WINDOW) // STEP) + 1)
    padded = np.full((n - 1) * STEP + WINDOW, PAD, dtype=np.int16)
    padded[: len(codes)] = codes
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STEP]


def text_bytes(text: str) -> bytes:
    return text.lower().encode()


@dataclass
class Network:
    languages: list[str]
    vectors: np.ndarray  # byte -> numbers; none for PAD
    filters: np.ndarray  # (widest * VECTOR, all filters); narrow filters have zeros at their end
    bias: np.ndarray
    dense: np.ndarray
    shift: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], rng: np.random.Generator) -> Network:
        total = len(WIDTHS) * FILTERS
        filters = rng.normal(0, 0.2, (max(WIDTHS) * VECTOR, total)) * cls.shape()
        vectors = rng.normal(0, 0.5, (PAD + 1, VECTOR))
        vectors[PAD] = 0
        dense = rng.normal(0, 0.1, (total, len(languages)))
        return cls(languages, *(a.astype(np.float32) for a in (vectors, filters, np.zeros(total), dense, np.zeros(len(languages)))))

    @staticmethod
    def shape() -> np.ndarray:
        """1 where a filter has a weight."""
        place = np.arange(max(WIDTHS) * VECTOR)[:, None]
        return (place < np.repeat(WIDTHS, FILTERS) * VECTOR).astype(np.float32)

    def spread(self, codes: np.ndarray) -> np.ndarray:
        """The bytes under a filter at every place of every window: (window, place, widest * VECTOR)."""
        seen = self.vectors[codes]
        out = np.empty((len(codes), STEP, max(WIDTHS) * VECTOR), dtype=np.float32)
        for i in range(max(WIDTHS)):
            out[:, :, i * VECTOR : (i + 1) * VECTOR] = seen[:, i : i + STEP]
        return out

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        found = np.empty((len(codes), len(self.languages)))
        for lo in range(0, len(codes), BATCH):
            part = codes[lo : lo + BATCH]
            highest = (self.spread(part) @ self.filters).max(axis=1) + self.bias
            found[lo : lo + BATCH] = softmax(np.maximum(highest, 0) @ self.dense + self.shift)
        return found


def softmax(scores: np.ndarray) -> np.ndarray:
    powers = np.exp((scores - scores.max(axis=1, keepdims=True)).astype(np.float64))
    return powers / powers.sum(axis=1, keepdims=True)


def trained(codes: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """A network fitted to labelled windows by Adam on the cross entropy."""
    rng = np.random.default_rng(seed)
    net, shape = Network.fresh(languages, rng), Network.shape()
    names = ["vectors", "filters", "bias", "dense", "shift"]
    first = {n: np.zeros_like(getattr(net, n)) for n in names}
    second = {n: np.zeros_like(getattr(net, n)) for n in names}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(codes))
        for lo in range(0, len(order), 64):
            own = order[lo : lo + 64]
            part, b = codes[own], len(own)
            under = net.spread(part)
            responses = under @ net.filters
            at = responses.argmax(axis=1)
            pooled = np.take_along_axis(responses, at[:, None, :], axis=1)[:, 0] + net.bias
            hidden = np.maximum(pooled, 0)
            error = softmax(hidden @ net.dense + net.shift).astype(np.float32)
            error[np.arange(b), labels[own]] -= 1
            error /= b
            back = (error @ net.dense.T) * (pooled > 0)
            below = np.take_along_axis(under, at[:, :, None], axis=1)  # (window, filter, weights): what each maximum saw
            grads = {"dense": hidden.T @ error, "shift": error.sum(axis=0), "bias": back.sum(axis=0)}
            grads["filters"] = np.einsum("bfw,bf->wf", below, back) * shape
            to_bytes = (back[:, :, None] * net.filters.T[None]).reshape(b, -1, max(WIDTHS), VECTOR)
            grads["vectors"] = np.zeros_like(net.vectors)
            places = at[:, :, None] + np.arange(max(WIDTHS))
            np.add.at(grads["vectors"], part[np.arange(b)[:, None, None], places], to_bytes)
            grads["vectors"][PAD] = 0
            step += 1
            rate = 0.004 * (1 - epoch / epochs)
            for name in names:
                first[name] += 0.1 * (grads[name] - first[name])
                second[name] += 0.001 * (grads[name] ** 2 - second[name])
                grown = np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8
                getattr(net, name)[...] -= rate * first[name] / (1 - 0.9**step) / grown
    return net


def has_letter(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def training_windows(labelled: DataFrame, documents: int = TRAIN_DOCUMENTS, per_document: int = TRAIN_WINDOWS) -> DataFrame:
    """(lang, window): windows spread over the texts of up to `documents` documents per language, those with the lowest hashes of
    doc_id. Ids are chosen before a text is read. Of several texts with one id the one with the lowest hash is read. Texts
    without a letter and rows without a label teach nothing.
    """
    at = F.xxhash64("doc_id")
    ids = labelled.where("lang is not null").select("lang", "doc_id").distinct()
    ids = ids.select("lang", "doc_id", at.alias("_at"), F.pmod(at, F.lit(64)).alias("_part"))
    for keys in (["lang", "_part"], ["lang"]):  # first within parts of a language, so that no task ranks a whole one
        order = W.partitionBy(*keys).orderBy("_at", "doc_id")
        ids = ids.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= documents).drop("_n")
    ids = saved(ids.select("lang", "doc_id"), "training-ids")
    few = F.broadcast(ids) if ids.count() <= FEW_IDS else ids  # `documents` for each language, of which there are few as a rule
    found = labelled.join(few, ["lang", "doc_id"], "left_semi").where(has_letter("text"))
    chosen = found.groupBy("lang", "doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("_least")).select("lang", F.col("_least.text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, found = [], []
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                own = windows(text_bytes(text.as_py()))
                for i in np.unique(np.linspace(0, len(own) - 1, per_document).astype(int)):
                    langs.append(lang.as_py())
                    found.append(own[i].astype("<i2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary())], ["lang", "window"])

    return chosen.mapInArrow(run, "lang string, window binary")


def learned(labelled: DataFrame, documents: int = TRAIN_DOCUMENTS) -> Network | None:
    """The network for the languages of the labelled rows (lang, doc_id, text); none if no row teaches."""
    rows = sorted(tuple(r) for r in training_windows(labelled, documents).collect())  # bounded by the sample
    if not rows:
        return None
    languages = sorted({r[0] for r in rows})
    codes = np.array([np.frombuffer(r[1], dtype="<i2") for r in rows])
    return trained(codes, np.array([languages.index(r[0]) for r in rows]), languages)


def predicted(documents: DataFrame, network: Network | None, columns: list[str], text: str = "text") -> DataFrame:
    """The given columns of every document with lang_pred and score, the probability of lang_pred.

    A text that is null or has no letter is `und` with score 0, as is every text if nothing was learned.
    """
    told = beside(documents, columns, text=F.when(has_letter(text), F.col(text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, texts = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows, batch.column(1)
            waiting, size = [], 0

            def settle(waiting: list) -> None:
                every = network.probabilities(np.concatenate([codes for _, codes, _ in waiting]))
                at = 0
                for i, codes, weights in waiting:  # noqa: B007
                    mean = weights @ every[at : at + len(weights)] / weights.sum()
                    at += len(weights)
                    langs[i], scores[i] = network.languages[int(mean.argmax())], float(min(1.0, mean.max()))  # noqa: B023

            for i in range(batch.num_rows if network else 0):
                if not texts[i].is_valid:
                    continue
                data = text_bytes(texts[i].as_py())
                codes = windows(data)
                weights = np.full(len(codes), float(STEP))
                weights[-1] = len(data) - (len(codes) - 1) * STEP
                waiting.append((i, codes, weights))
                size += len(codes)
                if size >= 4 * BATCH:
                    settle(waiting)
                    waiting, size = [], 0
            if waiting:
                settle(waiting)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["row", "lang_pred", "score"])

    return spread(told.mapInArrow(run, with_row(told, "lang_pred string, score double")))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of the documents that is never learned from; a null id is among them."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identified(documents: DataFrame, columns: list[str], training: DataFrame | None = None) -> DataFrame:
    """`predicted` with a network learned from the documents of `training` (these documents by default) that are not held out."""
    source = training if training is not None else documents
    network = learned(source.where(~held_out()).select("lang", "doc_id", "text"))
    return predicted(documents, network, columns)
