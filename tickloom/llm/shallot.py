"""Exact k-means over integer vectors by Shallot search.

Components become integers (``floor(scale * x)``), so distances, sums and centroids are exact. A vector remembers its
nearest and second-nearest centroid with an upper bound on the one distance and a lower bound on all others. When
centroids have moved, the bounds move along; only where they no longer decide is the vector searched anew. A search
starts at the closer of the two remembered centroids and reads that centroid's neighbours in order of distance: none
farther from it than the vector's distance to it plus the distance to the second nearest found so far can be among the
two nearest, and this ball shrinks while better ones are found. Bounds are floats rounded outwards; centroids that
survive are compared as integers, so ties are seen and go to the smaller number.

Each round is one pass over the rows and their state, written to the shared folder, and a sum by cluster that every
task adds up before anything is shuffled. What travels is k centroids and their distances, k by k.

Defined results: null vectors, and vectors of another length or with null or non-finite entries, are left out; of fewer
vectors than k each is a centroid; equal seeds order by the vector's components, a null id hashes as empty text;
repeated rows count each; a centroid that loses all vectors stays where it is; an empty table gives an empty one; other
columns aren't read. A component beyond 2**27 / scale is an error, as its squares leave the 64-bit integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

K, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, 2
#: Components up to here: their squared distances over all dimensions are 64-bit integers.
LARGEST = 1 << 27
#: Relative margin of the bounds, far over the rounding of doubles.
MARGIN = 1e-12


def integers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda v: F.floor(v.cast("double") * F.lit(float(scale))))


def whole(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


@dataclass
class Centroids:
    points: np.ndarray

    def __post_init__(self) -> None:
        far = self.points[:, None, :] - self.points[None, :, :]
        self.between = np.sqrt((far * far).sum(axis=2).astype(np.float64))
        self.order = np.argsort(self.between, axis=1, kind="stable")
        # A centroid comes first among its own neighbours, also where another lies in the same place.
        for j, row in enumerate(self.order):
            self.order[j] = np.concatenate([[j], row[row != j]])
        self.between = np.take_along_axis(self.between, self.order, axis=1)
        # Nearer to a centroid than half way to its nearest neighbour, no other can be as near.
        self.free = self.between[:, 1] / 2 * (1 - MARGIN) if len(self.points) > 1 else np.full(len(self.points), np.inf)

    def sha256(self, j: int) -> str:
        return hashlib.sha256(",".join(map(str, self.points[j].tolist())).encode()).hexdigest()


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    far = x - y
    return np.einsum("ij,ij->i", far, far)


def loosen(first: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray) -> None:
    """Bounds after the centroids moved so far."""
    upper += moved[first]
    upper *= 1 + MARGIN
    most = int(np.argmax(moved))
    others = np.delete(moved, most).max() if len(moved) > 1 else 0.0
    lower *= 1 - MARGIN
    lower -= np.where(first == most, others, moved[most]) * (1 + MARGIN)


def search(x: np.ndarray, first: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids) -> int:
    """Bring the state of the vectors x up to date, in place. Returns how many distances were computed."""
    if len(c.points) == 1:
        first[:], second[:], lower[:] = 0, 0, np.inf
        return 0

    def open_of(rows: np.ndarray) -> np.ndarray:
        return ~(upper[rows] < np.maximum(lower[rows], c.free[first[rows]]))

    rows = np.flatnonzero(open_of(np.arange(len(x))))
    near = squared(x[rows], c.points[first[rows]])
    upper[rows] = np.sqrt(near.astype(np.float64)) * (1 + MARGIN)
    left = open_of(rows)
    computed = len(rows)
    rows, near = rows[left], near[left]
    if not len(rows):
        return computed
    best, then = first[rows], second[rows]
    after = squared(x[rows], c.points[then])
    computed += len(rows)
    swap = (after < near) | ((after == near) & (then < best))
    best, then = np.where(swap, then, best), np.where(swap, best, then)
    near, after = np.where(swap, after, near), np.where(swap, near, after)
    centre, start, known = best.copy(), np.sqrt(near.astype(np.float64)), then.copy()
    going = np.arange(len(rows))
    for place in range(1, len(c.points)):
        ball = (start[going] + np.sqrt(after[going].astype(np.float64))) * (1 + MARGIN)
        going = going[c.between[centre[going], place] <= ball]
        if not len(going):
            break
        j = c.order[centre[going], place]
        new = j != known[going]
        at, j = going[new], j[new]
        d = squared(x[rows[at]], c.points[j])
        computed += len(at)
        wins = (d < near[at]) | ((d == near[at]) & (j < best[at]))
        runs_up = ~wins & ((d < after[at]) | ((d == after[at]) & (j < then[at])))
        up, to = at[wins], at[runs_up]
        then[up], after[up] = best[up], near[up]
        best[up], near[up] = j[wins], d[wins]
        then[to], after[to] = j[runs_up], d[runs_up]
    first[rows], second[rows] = best, then
    upper[rows] = np.sqrt(near.astype(np.float64)) * (1 + MARGIN)
    lower[rows] = np.sqrt(after.astype(np.float64)) * (1 - MARGIN)
    return computed


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix of 64-bit integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def assign(state: DataFrame, c: Centroids, moved: np.ndarray, last: bool = False) -> DataFrame:
    """One pass: the state after a search. The last pass gives id, cluster and distance instead."""
    kind = state.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch["x"])
            first, second = (batch[n].to_numpy().astype(np.int64) for n in ("first", "second"))
            upper, lower = (batch[n].to_numpy().copy() for n in ("upper", "lower"))
            if len(x):
                loosen(first, upper, lower, moved)
                search(x, first, second, upper, lower, c)
            if last:
                columns = {"vec_id": batch["vec_id"], "cluster": pa.array(first, pa.int32()), "distance": pa.array(squared(x, c.points[first]) if len(x) else [], pa.int64())}
            else:
                columns = {"vec_id": batch["vec_id"], "x": batch["x"], "first": pa.array(first, pa.int32()), "second": pa.array(second, pa.int32()), "upper": upper, "lower": lower}
            yield pa.RecordBatch.from_pydict(columns)

    shape = "cluster int, distance long" if last else "x array<int>, first int, second int, upper double, lower double"
    return state.mapInArrow(run, f"vec_id {kind}, {shape}")


def means(state: DataFrame, c: Centroids) -> Centroids:
    """Exact floor of the mean of each cluster. Every task hands on one row a cluster and dimension at most."""
    k, dims = c.points.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            first = batch["first"].to_numpy()
            if not len(first):
                continue
            x, order = matrix(batch["x"]), np.argsort(first, kind="stable")
            own, at = np.unique(first[order], return_index=True)
            total[own] += np.add.reduceat(x[order], at, axis=0)
            n += np.bincount(first, minlength=k)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(held, dims), pa.int32()), pa.array(np.tile(np.arange(dims), len(held)), pa.int32()), pa.array(total[held].ravel()), pa.array(np.repeat(n[held], dims))], names=["cluster", "dim", "total", "n"]
        )

    sums = state.select("first", "x").mapInArrow(run, "cluster int, dim int, total long, n long")
    found = sums.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
    points = c.points.copy()
    for r in found:
        points[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
    return Centroids(points)


def seeds(rows: DataFrame, k: int, seed: int) -> Centroids | None:
    """The k vectors whose ids hash lowest, in that order; none if there are no vectors."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    chosen = rows.select(h.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return Centroids(np.array([r["x"] for r in chosen], np.int64)) if chosen else None


@dataclass
class Clusters:
    rows: DataFrame
    centroids: Centroids | None
    inertia: dict[int, int]


def fit(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> Clusters:
    """``rounds`` rounds of Lloyd's algorithm and a last assignment: rows (vec_id, cluster, distance), centroids, and each cluster's inertia."""
    entry = F.col("e")
    small = F.forall(F.col("x"), lambda v: (v < LARGEST) & (v > -LARGEST))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("e")).where(whole(entry) & (F.size(entry) == dims)).select("vec_id", integers(entry, scale).alias("x"))
    checked = F.when(small, F.col("x").cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component of a vector is over {LARGEST} / {scale}")))
    # As nothing is known yet, every vector is searched from the first centroid.
    state = materialise(rows.select("vec_id", checked.alias("x"), F.lit(0).alias("first"), F.lit(1).alias("second"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower")))
    c = seeds(state, k, seed)
    if c is None:
        return Clusters(state.select("vec_id", F.col("first").alias("cluster"), F.lit(0).cast("long").alias("distance")), c, {})
    moved = np.zeros(len(c.points))
    for _ in range(rounds):
        now = materialise(assign(state, c, moved))
        discard(state)
        state, before = now, c
        c = means(state, before)
        moved = np.sqrt(squared(c.points, before.points).astype(np.float64))
        if not moved.any():  # the next rounds would change nothing
            break
    out = materialise(assign(state, c, moved, last=True))
    discard(state)
    inertia = {r["cluster"]: int(r["d"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    return Clusters(out, c, inertia)


def clustered(vectors: DataFrame, **how) -> DataFrame:
    """Each vector with its cluster, distance, the inertias, and the hash of its centroid."""
    found = fit(vectors, **how)
    all_of = sum(found.inertia.values())
    table = [(j, own, all_of, found.centroids.sha256(j)) for j, own in sorted(found.inertia.items())]
    # A row for each cluster: k at most.
    small = vectors.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(small), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> str:
    """Plain k-means, every vector against every centroid."""
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims})""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x
  FROM (SELECT sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM v ORDER BY h, x LIMIT {k}))""",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""a{i} AS MATERIALIZED (SELECT r, vec_id, v.x AS x, c, CAST(list_sum(list_transform(list_zip(v.x, c{i}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
  FROM v CROSS JOIN c{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"""
        )
        if i < rounds:
            parts.append(
                f"""m{i} AS (SELECT c, list((s - ((s % n + n) % n)) // n ORDER BY i) AS x
  FROM (SELECT c, i, sum(e) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{i}) GROUP BY c, i) GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c, CAST(coalesce(m{i}.x, c{i}.x) AS BIGINT[]) AS x FROM c{i} LEFT JOIN m{i} USING (c))"""
            )
    with_ = ",\n".join(parts)
    return f"""WITH {with_}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (c)"""


ORACLE_SQL = _oracle()
