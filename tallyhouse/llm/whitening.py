"""Embedding whitening on leading principal components, by Chebyshev-filtered subspace iteration (Zhou et al., 2006).

The components are eigenvectors of the covariance V of the fit list (every distinct vector once). V is never formed: a pass over the stored fit
list returns the sum of X'(XQ) over its centred rows X for a block Q of a few columns. A round

1. applies a Chebyshev polynomial of V to the block, one pass for each degree: its recurrence keeps the unwanted spectrum within [-1, 1] and makes
   all above grow with the degree,
2. orthonormalizes the block (QR) and solves V within it (Rayleigh-Ritz, one pass more).

The ends of the unwanted spectrum are the block's lowest Ritz value and the lower end that a few Lanczos steps give. Rounds end when the residual
of every wanted pair is at the level of rounding. Then the block's other columns start anew at random for one more round: if that
finds the same values, the result is certified; if not, rounds go on. A block that no longer gains is doubled, up to all dimensions, where
Rayleigh-Ritz alone is exact; so equal eigenvalues cannot keep the iteration from ending.

A pass returns one block-sized sum per task, or per group of tasks where those together would pass RETURNED bytes, so what reaches the driver
depends on the number of dimensions alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.storage import saved
from tallyhouse.llm.vectors import finite

COMPONENTS = 4
GUARD = 12  # columns of the block besides the wanted ones, at first
DEGREE = 10  # of the filter
LANCZOS = 10  # steps for the lower end
ROUNDS = 200
EPS = float(np.finfo(np.float64).eps)
RETURNED = 32 << 20  # bytes that a pass may return to the driver
GROUPS = 64  # sums that a pass returns beyond that
SEED = 20
LIMIT = (1 << 63) - 1

Kernel = Callable[[np.ndarray], np.ndarray]


def whole_components(vector: str, scale: int) -> F.Column:
    """floor(scale * x) for each component x, computed in double, as a long."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _summed(rows: DataFrame, dims: int, kernel: Kernel, size: int, tasks: int) -> np.ndarray:
    """The sum of kernel(batch) over all batches of the column x, `size` numbers each; `tasks` read the rows."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += kernel(_matrix(batch.column(0), dims)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["total"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += _matrix(batch.column(0), size).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["total"])

    sums = rows.select("x").mapInArrow(part, "total array<double>")
    if tasks * size * 8 > RETURNED:
        sums = sums.repartition(GROUPS, F.spark_partition_id()).mapInArrow(merge, "total array<double>")
    return np.sum([np.array(r.total) for r in sums.collect()], axis=0)


def _exact_sums(rows: DataFrame, dims: int) -> tuple[int, list[int]]:
    """The number of rows and the sum per dimension as Python integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, dtype=np.int64), np.zeros(dims, dtype=np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([high]), pa.array([low])], ["n", "high", "low"])

    parts = rows.select("x").mapInArrow(run, "n long, high array<long>, low array<long>")
    cells = parts.select("n", F.posexplode(F.arrays_zip("high", "low")).alias("at", "s")).groupBy("at").agg(
        F.sum("n").alias("n"), F.sum(F.col("s.high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("s.low").cast("decimal(38,0)")).alias("low"))
    found = sorted(tuple(r) for r in cells.collect())  # a row per dimension
    return int(found[0][1]) if found else 0, [(int(high) << 32) + int(low) for _, _, high, low in found]


@dataclass
class Covariance:
    """V of the stored fit list as an operator on blocks."""

    rows: DataFrame
    dims: int
    n: int
    mean: np.ndarray
    tasks: int

    def average(self, kernel: Kernel, size: int) -> np.ndarray:
        """The sum of kernel(centred rows) over the fit list, divided by its size."""
        mean = self.mean
        return _summed(self.rows, self.dims, lambda x: kernel(x - mean), size, self.tasks) / self.n

    def __matmul__(self, block: np.ndarray) -> np.ndarray:
        return self.average(lambda centred: centred.T @ (centred @ block), block.size).reshape(block.shape)

    def trace(self) -> float:
        return float(self.average(lambda centred: np.square(centred).sum(axis=0), self.dims).sum())


def lower_end(apply: Callable[[np.ndarray], np.ndarray], dims: int, rng: np.random.Generator, steps: int = LANCZOS) -> float:
    """A value that hardly any eigenvalue is below: the lowest Ritz value of a few Lanczos steps, less its residual; 0 at least."""
    basis = [rng.normal(size=dims)]
    basis[0] /= np.linalg.norm(basis[0])
    along, beside = [], []
    for _ in range(min(steps, dims)):
        w = apply(basis[-1][:, None])[:, 0]
        along.append(basis[-1] @ w)
        for q in basis * 2:  # twice, against rounding
            w = w - (q @ w) * q
        beside.append(np.linalg.norm(w))
        if beside[-1] <= 1e-12 * abs(along[0]):
            break
        basis.append(w / beside[-1])
    values, vectors = np.linalg.eigh(np.diag(along) + np.diag(beside[: len(along) - 1], 1) + np.diag(beside[: len(along) - 1], -1))
    return max(0.0, values[0] - beside[len(along) - 1] * abs(vectors[-1, 0]))


def filtered(apply: Callable[[np.ndarray], np.ndarray], block: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """The Chebyshev polynomial of `degree` that stays small on [low, high], applied to a block; scaled so that it is about 1 at `top`."""
    centre, half = (low + high) / 2, (high - low) / 2
    scale = first = half / (top - centre)
    before, now = block, (apply(block) - centre * block) * (scale / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - scale)
        before, now = now, (apply(now) - centre * now) * (2 * after / half) - scale * after * before
        scale = after
    return now


def leading_pairs(apply: Callable[[np.ndarray], np.ndarray], dims: int, k: int, guard: int = GUARD, degree: int = DEGREE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The k highest eigenvalues, falling, and their unit eigenvectors as columns, of a symmetric operator without negative eigenvalues."""
    rng = np.random.default_rng(seed)
    k = min(k, dims)

    def ritz(block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        basis = np.linalg.qr(block)[0]
        image = apply(basis)
        within = basis.T @ image
        values, turn = np.linalg.eigh((within + within.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        return values, basis @ turn, np.linalg.norm(image @ turn - (basis @ turn) * values, axis=0)

    size = min(dims, k + guard)
    values, block, residual = ritz(rng.normal(size=(dims, size)))
    low = lower_end(apply, dims, rng) if size < dims else 0.0
    best, certified = np.inf, None
    for _ in range(ROUNDS):
        error, scale = residual[:k].max(), max(values[0], 0.0)
        if size == dims or scale == 0:  # Rayleigh-Ritz over all dimensions, or no variance at all
            return values[:k], block[:, :k]
        settled = error <= 16 * EPS * np.sqrt(dims) * scale or (error <= 1e-11 * scale and error > best / 2)
        if settled and certified is not None and np.abs(values[:k] - certified).max() <= 1e-11 * scale:
            return values[:k], block[:, :k]
        if settled:
            certified = values[:k].copy()
            block = np.hstack([block[:, :k], rng.normal(size=(dims, size - k))])
            best = np.inf
        else:
            if error > best / 2:  # hardly a gain: a wider block parts what this one cannot
                size = min(dims, 2 * size)
                block = np.hstack([block, rng.normal(size=(dims, size - block.shape[1]))])
            best = min(best, error)
        if size < dims:
            high = min(values[-1], values[k - 1] * (1 - 1e-9))
            edge = min(low, high * (1 - 1e-6))
            block = filtered(apply, block, edge, high, max(values[0], high * (1 + 1e-6)), degree)
        values, block, residual = ritz(block)
    raise ArithmeticError(f"not certified after {ROUNDS} rounds: residual {error} of {scale}")


@dataclass
class Whitening:
    """What a fit list gives: its size, sums per dimension, eigenvalues and eigenvectors, variance in all, and the error."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def scaled(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def fitted(fit: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of a stored frame of distinct x (array<long> of `dims` numbers). Components without variance are left out."""
    n, sums = _exact_sums(fit, dims)
    mean = np.array([s / n for s in sums])
    operator = Covariance(fit, dims, n, mean, fit.rdd.getNumPartitions())
    trace = operator.trace()
    values, vectors = leading_pairs(lambda block: operator @ block, dims, components)
    kept = values > trace * dims * 4 * EPS
    values, vectors = values[kept], vectors[:, kept]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), range(vectors.shape[1])])
    result = Whitening(n, sums, values, vectors, trace, 0.0)
    if len(values):
        scaled, k = result.scaled(), len(values)

        def kernel(centred: np.ndarray) -> np.ndarray:
            y = centred @ scaled
            return np.concatenate([(y.T @ y).ravel(), y.sum(axis=0)])

        found = operator.average(kernel, k * k + k)
        result.error = float(np.abs(found[: k * k].reshape(k, k) - np.outer(found[k * k :], found[k * k :]) - np.eye(k)).max())
    return result


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over dimensions of (n x - S)^2 for each row, exact; none where it passes 64 bits."""
    dims = x.shape[1]
    widest = max(n * (int(np.abs(x.astype(np.float64)).max(initial=0)) + 1), *map(abs, sums)) * 2
    if widest * widest * dims <= LIMIT:
        return np.square(n * x - np.array(sums, dtype=np.int64)).sum(axis=1).tolist()
    found = np.square(n * x.astype(object) - np.array(sums, dtype=object)).sum(axis=1).tolist()
    return [d if d <= LIMIT else None for d in found]


OUTPUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def projected(vectors: DataFrame, result: Whitening, dims: int) -> DataFrame:
    """The rows (id, x) with one row per component."""
    k, mean = len(result.values), result.mean
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scaled, explained = result.scaled(), result.values / result.trace
        for batch in batches:
            x = _matrix(batch.column(1), dims)
            white = (x - mean) @ scaled
            each = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), result.n)),
                 pa.array(deviations(x, result.n, result.sums), pa.int64()).take(pa.array(each)), pa.array(white.ravel()),
                 pa.array(np.tile(explained, len(x))), pa.array(np.full(len(each), result.error))],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, f"id {kind}, {OUTPUT}")


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): every row's coordinates on the first components.

    `vectors` has id (of any kind, null and repeated ids stay) and x (array<long>, no null within); rows whose x is null are left out, other
    columns are not looked at. Each distinct x counts once in the fit list, however often it is repeated. Vectors of one length are fitted
    among themselves (n, components and error are theirs); a vector without components has no row. There are as many components as have variance: none
    for a single vector. `deviation` is null where its exact value passes 64 bits. Equal eigenvalues have some orthonormal basis of
    their space; of the two signs that with the largest entry positive is taken. No vectors: no rows.
    """
    kept = vectors.select("id", "x").where("x is not null")
    fit = saved(kept.select("x").distinct(), "fit-list")
    found = vectors.sparkSession.createDataFrame([], f"id {vectors.schema['id'].dataType.simpleString()}, {OUTPUT}")
    for dims in sorted(r[0] for r in fit.select(F.size("x")).distinct().collect()):  # one row per vector length
        if dims:
            of_length = F.size("x") == dims
            result = fitted(fit.where(of_length), dims, components)
            if len(result.values):
                found = found.union(projected(kept.where(of_length), result, dims))
    return found


def usable(vectors: DataFrame, id_column: str, vector: str, scale: int) -> DataFrame:
    """(id, x): the rows whose vector is not null and holds finite numbers only, as whole components."""
    return vectors.where(finite(vector)).select(F.col(id_column).alias("id"), whole_components(vector, scale).alias("x"))
