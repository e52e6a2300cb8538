"""Whitening against eigh of the whole covariance, exact deviations, spectra with equal and missing eigenvalues."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import SAMPLE

from tallyhouse.llm import queries, whitening

SCHEMA = "id long, x array<long>"


def plain(rows, components=4):
    """(n, sums, eigenvalues, eigenvectors, trace) of the distinct vectors."""
    fit = np.array(sorted({tuple(x) for _, x in rows}), dtype=object)
    sums = [int(sum(column)) for column in fit.T]
    centred = np.array(fit - np.array(sums, dtype=object) / len(fit), dtype=float)
    v = centred.T @ centred / len(fit)
    values, vectors = np.linalg.eigh(v)
    return len(fit), sums, values[::-1][:components], vectors[:, ::-1][:, :components], np.trace(v)


def against(rows, found, components=4):
    n, sums, values, vectors, trace = plain(rows, components)
    kept = [i for i in range(len(values)) if values[i] > 1e-9 * trace]
    assert len(found) == len(rows) * len(kept) and {r.component for r in found} == {i + 1 for i in kept}
    assert {r.n for r in found} == {n} and len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9
    by_id = dict(rows)
    for c in kept:
        own = [r for r in found if r.component == c + 1]
        white = np.array([[float(v - s / n) for v, s in zip(by_id[r.id], sums, strict=True)] for r in own]) @ vectors[:, c] / np.sqrt(values[c])
        got = np.array([r.whitened for r in own])
        assert min(np.abs(got - white).max(), np.abs(got + white).max()) < 1e-8
        assert all(abs(r.explained - values[c] / trace) < 1e-10 for r in own)
        assert all(r.deviation == sum((n * v - s) ** 2 for v, s in zip(by_id[r.id], sums, strict=True)) for r in own)


def test_query_equals_eigh(spark):
    table = spark.read.parquet(f"{SAMPLE}/embeddings.parquet")
    found = queries.op11_whitening(spark, SAMPLE).withColumnRenamed("vec_id", "id").collect()
    against([(r.vec_id, [int(np.floor(256 * float(c))) for c in r.embedding]) for r in table.collect()], found)


def test_repeated_vectors_count_once(table):
    rng = np.random.default_rng(1)
    base = [(i, [int(v) for v in rng.normal(0, 9, 6) * range(1, 7)]) for i in range(40)]
    rows = base + [(100 + i, base[0][1]) for i in range(300)]
    against(rows, whitening.whitened(table(SCHEMA, rows, clash=("component", "n", "vec_id", "whitened"))).collect())


def test_few_dimensions_and_ranks(table):
    line = [(i, [i, 2 * i, -i]) for i in range(9)]
    against(line, whitening.whitened(table(SCHEMA, line)).collect())  # one component has variance
    flat = [(i, [i * i]) for i in range(5)]
    against(flat, whitening.whitened(table(SCHEMA, flat)).collect())
    assert whitening.whitened(table(SCHEMA, [(1, [3, 4]), (2, [3, 4]), (None, [3, 4])])).collect() == []
    assert whitening.whitened(table(SCHEMA, [])).collect() == []
    assert whitening.whitened(table(SCHEMA, [(1, []), (2, None)])).collect() == []


def test_null_ids_and_lengths(table):
    rows = [(None, [1, 5]), (None, [1, 5]), (7, [2, -3]), (8, [4, 4]), (9, [1]), (10, [6])]
    found = whitening.whitened(table(SCHEMA, rows)).collect()
    assert sorted((r.id or 0, r.component, r.n) for r in found) == sorted([(0, 1, 3), (0, 2, 3)] * 2 + [(i, c, 3) for i in (7, 8) for c in (1, 2)] + [(9, 1, 2), (10, 1, 2)])


def test_unusable_rows_are_dropped(spark):
    rows = [(1, [0.5, 1.0]), (2, None), (3, [0.1, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [-0.001, 2.0]), (7, [0.25, -1.0])]
    found = whitening.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding", 256)
    assert sorted(map(tuple, found.collect())) == [(1, [128, 256]), (6, [-1, 512]), (7, [64, -256])]


def test_deviations_are_exact():
    x = np.array([[3, -4], [1 << 40, 5], [-(1 << 62), 1 << 61]])
    exact = [sum((1000 * int(v) - s) ** 2 for v, s in zip(row, (17, -(1 << 50)), strict=True)) for row in x]
    assert whitening.deviations(x, 1000, [17, -(1 << 50)]) == [e if e < 1 << 63 else None for e in exact]
    near = np.array([[1 << 20, 2], [3, 4]])
    assert whitening.deviations(near, 10**8, [5, 6]) == [None, (3 * 10**8 - 5) ** 2 + (4 * 10**8 - 6) ** 2]


@pytest.mark.parametrize("spectrum", [
    [9.0] * 64, [5.0] * 30 + [4.99] * 34, [7, 7, 7, 7, 7, 7] + [1.0] * 58, [3, 2, 1] + [0.0] * 61, [1 + i * 1e-3 for i in range(64)], [1e9, 1e3, 1, 0.5] + [0.1] * 60, [0.0] * 64,
    [2.0] * 3 + [1.0 + 1e-7 * i for i in range(61)]])
def test_spectra(spectrum):
    rng = np.random.default_rng(3)
    turn = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    v = (turn * spectrum) @ turn.T
    values, vectors = whitening.leading_pairs(lambda block: v @ block, 64, 4)
    top = max(max(spectrum), 1e-300)
    assert np.allclose(values, sorted(spectrum, reverse=True)[:4], rtol=0, atol=1e-12 * top)
    assert np.abs(v @ vectors - vectors * values).max() <= 1e-10 * top and np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-12


def test_a_filter_grows_as_the_polynomial():
    values = np.array([4.0, 2.0, 1.5, 1.0])
    out = whitening.filtered(lambda block: values[:, None] * block, np.eye(4), 1.0, 2.0, 4.0, 6)
    chebyshev = np.cosh(6 * np.arccosh((4.0 - 1.5) / 0.5))
    assert out[0, 0] == pytest.approx(1.0) and np.abs(np.diag(out)[1:]).max() <= 1.0001 / chebyshev


def test_sums_are_merged_before_the_driver(spark, monkeypatch):
    monkeypatch.setattr(whitening, "RETURNED", 1)
    rows = [(i, [i % 7, i % 5, i]) for i in range(50)]
    found = whitening.whitened(spark.createDataFrame(rows, SCHEMA).repartition(5))
    against(rows, found.where(F.col("component") > 0).collect())
