"""Whitening of embeddings by polarisation covariance.

Entries become integers, ``x = floor(scale * c)``. The fit list holds each distinct vector once. Its covariance comes
from squares alone: the squared centred values of every dimension, and of the sum of every pair of dimensions, are
added up; then 2 cov(i, j) = var(i + j) - var(i) - var(j). Values are centred before squaring, at the integer part m of
the mean; what the mean has beyond m is an exact fraction r / n, with 0 <= r < n, that is taken out of the totals. All
totals are exact integers: tasks add up in 64 bits while a bound shows that this suffices and in Python's integers
beyond, and hand totals on as digits of 32 bits, which Spark adds up. So each covariance is an exact fraction, rounded
once. The matrix, dimensions by dimensions, goes to ``eigh``; components are numbered by falling eigenvalue.

Each task hands on dims * (dims + 1) / 2 totals, however many rows it has. The driver holds the matrix, so this is for
embeddings of some thousand dimensions at most.

Defined results: null vectors and those with null or non-finite entries are dropped; of several lengths the most
frequent counts, the longer if tied, and vectors of others are dropped too; entries beyond 64-bit integers become the
largest or least of them; repeated rows are fitted once and returned each; a component without variance has null
``whitened``, and ``explained`` is null if no component has any; ``identity_error`` covers the components with variance;
an empty table gives an empty one; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise
from .shallot import integers, matrix, whole

SCALE, COMPONENTS = 256, 4
#: Rows that are squared at once.
BLOCK = 2048
#: An eigenvalue below this share of the trace, times the dimensions, is rounding.
NOTHING = 1e-14
SAFE = 1 << 62


def digits(value: int) -> Iterator[int]:
    """Base 2**32, lowest first; the last one carries the sign."""
    while not -(1 << 32) < value < 1 << 32:
        yield value & 0xFFFFFFFF
        value >>= 32
    yield value


def totals(rows: DataFrame, of_block, width: int) -> list[int]:
    """Exact sums over all rows. ``of_block`` maps a matrix of integers to ``width`` exact totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [0] * width
        for batch in batches:
            x = matrix(batch["x"])
            for at in range(0, len(x), BLOCK):
                held = [a + int(b) for a, b in zip(held, of_block(x[at : at + BLOCK]), strict=True)]
        out = [(i, p, d) for i, value in enumerate(held) if value for p, d in enumerate(digits(value))]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.int64()))], names=["k", "p", "d"])

    sums = rows.select("x").mapInArrow(run, "k int, p int, d long").groupBy("k", "p").agg(F.sum("d").alias("d")).collect()
    found = [0] * width
    for r in sums:
        found[r["k"]] += int(r["d"]) << (32 * r["p"])
    return found


def plain_sums(x: np.ndarray) -> list[int]:
    """Number of rows and sum of each dimension; halves of 32 bits can't overflow."""
    high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
    return [len(x), *((int(h) << 32) + int(lo) for h, lo in zip(high, low, strict=True))]


def squares_of(middle: list[int]):
    """Totals of the squares of each centred dimension, then of each pair's sum."""
    dims = len(middle)

    def of_block(x: np.ndarray) -> list[int]:
        reach = max((abs(int(v) - m) for ends in (x.min(axis=0), x.max(axis=0)) for v, m in zip(ends, middle, strict=True)), default=0)
        exact = (2 * reach) ** 2 * len(x) < SAFE
        z = x - np.array(middle, np.int64) if exact else x.astype(object) - np.array(middle, object)
        out = (z * z).sum(axis=0).tolist()
        for i in range(dims - 1):
            both = z[:, i : i + 1] + z[:, i + 1 :]
            out += (np.einsum("ij,ij->j", both, both) if exact else (both * both).sum(axis=0)).tolist()
        return out

    return of_block


@dataclass
class Whitening:
    """What was fitted: n, sums S, exact covariance's eigenvalues and unit eigenvectors (columns)."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def middle(self) -> list[int]:
        return [s // self.n for s in self.sums]

    @property
    def rest(self) -> list[int]:
        return [s % self.n for s in self.sums]

    def projection(self, components: int) -> tuple[np.ndarray, np.ndarray]:
        """Columns that whiten a centred vector, and the variance each has; no column where it has none."""
        e = self.values[:components]
        real = e > NOTHING * len(self.sums) * max(float(np.trace(self.covariance)), 0.0)
        return self.vectors[:, :components] / np.sqrt(np.where(real, e, 1.0)), real


def covariance(n: int, rest: list[int], squares: list[int]) -> np.ndarray:
    """Polarisation: n**2 * var of a sum is n * (its squares) - (its rest)**2, all integers."""
    dims = len(rest)
    var = [n * squares[i] - rest[i] ** 2 for i in range(dims)]
    out, at = np.zeros((dims, dims)), dims
    for i in range(dims):
        out[i, i] = var[i] / n**2
        for j in range(i + 1, dims):
            both = n * squares[at] - (rest[i] + rest[j]) ** 2
            out[i, j] = out[j, i] = (both - var[i] - var[j]) / (2 * n**2)
            at += 1
    return out


def fit(rows: DataFrame, dims: int) -> Whitening:
    """rows: (x), each distinct vector once."""
    n, *sums = totals(rows, plain_sums, dims + 1)
    squares = totals(rows, squares_of([s // n for s in sums]), dims * (dims + 1) // 2)
    v = covariance(n, [s % n for s in sums], squares)
    values, vectors = np.linalg.eigh(v)
    return Whitening(n, sums, v, values[::-1], vectors[:, ::-1])


def centred(x: np.ndarray, w: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """x minus the integer part of the mean, exact as far as needed, and x minus the mean as doubles."""
    low, high = x.min(initial=0), x.max(initial=0)
    fits = all(abs(int(end) - m) < 1 << 53 for end in (low, high) for m in w.middle)
    z = x - np.array(w.middle, np.int64) if fits else x.astype(object) - np.array(w.middle, object)
    return z, z.astype(np.float64) - np.array([r / w.n for r in w.rest])


def deviations(z: np.ndarray, w: Whitening) -> list[int]:
    """Sum over dimensions of (n * x - S)**2 = n**2 * sum z**2 - 2 * n * sum z * r + sum r**2, exact."""
    reach, dims = max(abs(int(z.min(initial=0))), abs(int(z.max(initial=0)))), len(w.sums)
    if reach * max(reach, w.n) * dims >= SAFE:
        z = z.astype(object)
    rest = np.array(w.rest, z.dtype)
    square, cross, plain = (z * z).sum(axis=1).tolist(), (z * rest).sum(axis=1).tolist(), sum(r * r for r in w.rest)
    return [w.n**2 * a - 2 * w.n * b + plain for a, b in zip(square, cross, strict=True)]


def identity_error(rows: DataFrame, w: Whitening, components: int) -> float | None:
    """Largest difference between the whitened fit list's covariance and the identity, as measured over all of it."""
    project, real = w.projection(components)
    kept = np.flatnonzero(real)
    if not len(kept):
        return None
    names = [f"w{i}" for i in range(len(kept))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = centred(matrix(batch["x"]), w)[1] @ project[:, kept] if batch.num_rows else np.zeros((0, len(kept)))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in out.T], names=names)

    white = rows.select("x").mapInArrow(run, ", ".join(f"{c} double" for c in names))
    pairs = [(a, b) for a in names for b in names if a <= b]
    found = white.agg(*[F.covar_pop(a, b).alias(f"{a}_{b}") for a, b in pairs]).first()
    return max(abs(found[f"{a}_{b}"] - (a == b)) for a, b in pairs)


def whitened(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """A row for each remaining vector and component: vec_id, component, n, deviation (decimal), whitened, explained, identity_error."""
    entry = F.col("e")
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("e")).where(whole(entry)).select("vec_id", integers(entry, scale).alias("x"))
    rows = materialise(rows)
    kind = rows.schema["vec_id"].dataType.simpleString()
    shape = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    lengths = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    dims = lengths[0]["dims"] if lengths else 0
    if not dims:
        discard(rows)
        return _nothing(vectors.sparkSession, shape)
    fine = rows.where(F.size("x") == dims)
    distinct = materialise(fine.select("x").distinct())
    w = fit(distinct, dims)
    shown = min(components, dims)
    error = identity_error(distinct, w, shown)
    discard(distinct)
    project, real = w.projection(shown)
    trace = float(np.trace(w.covariance))
    explained = [max(float(e), 0.0) / trace if trace > 0 else None for e in w.values[:shown]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            z, y = centred(matrix(batch["x"]), w)
            values, known = (y @ project).ravel(), np.tile(real, size)
            each = np.repeat(np.arange(size), shown)
            columns = [
                batch["vec_id"].take(pa.array(each)),
                pa.array(np.tile(np.arange(1, shown + 1), size), pa.int32()),
                pa.array(np.full(size * shown, w.n), pa.int64()),
                pa.array(deviations(z, w), pa.decimal128(38, 0)).take(pa.array(each)),
                pa.array(values, mask=~known),
                pa.array(explained * size, pa.float64()),
                pa.array([error] * (size * shown), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return fine.mapInArrow(run, shape)


def _nothing(spark: SparkSession, shape: str) -> DataFrame:
    return spark.createDataFrame([], shape)
