"""Centroid clustering over a VA-file: vectors as few-bit cells, exact vectors only where the cells leave a choice.

Components become integers, so every distance, sum and mean is exact and equal input gives equal output. Each dimension is cut into
2^bits cells; a vector's approximation is its cell numbers, one byte each. For a round, one lookup table per dimension holds for each
cell and centroid the least and the largest that any component in that cell can add to the distance; summed over dimensions they bound the
distance to each centroid. If one centroid's upper bound lies below all other lower bounds, the vector is settled without being seen.
Otherwise it is compared exactly with the centroids whose intervals overlap.

The intervals are of |x - c|^2 - |x - r|^2 with r the middle of the centroids: the subtracted term is the same for all centroids, so
nothing is lost by leaving it out, and what is left is linear in x with the small factor c - r, so its intervals are several times narrower
than those of the plain distance.

The approximations and the vectors are two written tables. The first pass sums all vectors of each cluster. A later round reads the
approximations only and asks for the vectors that the bounds do not settle under the old and the new centroids, or settle differently;
those are joined by row number and give the change of the sums. All other vectors stay where they were and need no reading. When no
centroid moves, the following rounds would repeat it and are left out. The last assignment reads all vectors once, for their distances.
Only sums, counts and centroids (k vectors) reach the driver, and a bounded sample that sets the cells' borders; borders change how much
is read and never what results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoevents.llm.common import cut

CLUSTERS, ROUNDS, DIM, SEED, SCALE = 8, 10, 64, 3, 1024
#: Bits of a cell number, at most 8.
BITS = 6
#: Rows whose components set the inner borders of the cells.
BORDER_ROWS = 4096
#: Integers beyond this would not leave room for a squared distance in a long.
LARGEST = 1 << 27
_STEP = 8192


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(row, id, v array<int>) of the rows that take part, numbered and written out."""
    v = F.col(f"`{vector}`").cast("array<double>")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.select(F.col(f"`{id_col}`").alias("id"), v.alias("x")).filter((F.size(v) == dim) & finite)
    fits = F.forall("x", lambda x: F.abs(x) <= LARGEST // scale)
    checked = kept.withColumn("x", F.when(fits, F.col("x")).otherwise(
        F.raise_error(F.lit(f"a component beyond {LARGEST // scale} has no squared distance in a long")).cast("array<double>")))
    whole = F.transform("x", lambda x: F.floor(F.lit(float(scale)) * x).cast("int"))
    return cut(checked.select(F.monotonically_increasing_id().alias("row"), "id", whole.alias("v")))


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors whose ids hash lowest; of equal ids the smaller vector comes first. Null ids never start a cluster."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    got = vectors.filter("id is not null").select(h.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    return np.array([r.v for r in got], np.int64).reshape(len(got), -1 if got else 0)


class Cells:
    """Borders of the cells of every dimension: cell j holds the integers low[d, j]..high[d, j]."""

    def __init__(self, borders: np.ndarray, least: np.ndarray, largest: np.ndarray):
        self.borders = borders  # dim x (cells - 1), ascending; a component belongs to the cell after the borders it reaches
        self.low = np.concatenate((least[:, None], borders), axis=1)
        self.high = np.concatenate((borders - 1, largest[:, None]), axis=1)

    @classmethod
    def measured(cls, vectors: DataFrame, dim: int, bits: int = BITS, rows: int = BORDER_ROWS) -> Cells:
        """Outer borders over all rows, inner ones at the quantiles of a bounded sample chosen by hash."""
        def run(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            least, largest = np.full(dim, LARGEST), np.full(dim, -LARGEST)
            for batch in them:
                for part in _steps(batch):
                    v = _matrix(part.column(0), dim)
                    least, largest = np.minimum(least, v.min(axis=0)), np.maximum(largest, v.max(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(least), pa.array(largest)], names=["d", "least", "largest"])

        ends = (vectors.select("v").mapInArrow(run, "d bigint, least bigint, largest bigint").groupBy("d")
                .agg(F.min("least").alias("least"), F.max("largest").alias("largest")).orderBy("d").collect())
        sample = np.array([r.v for r in vectors.orderBy(F.xxhash64("row")).select("v").limit(rows).collect()], np.int64)
        at = np.linspace(0, 1, (1 << bits) + 1)[1:-1]
        borders = np.quantile(sample, at, axis=0, method="higher").T.astype(np.int64)
        return cls(borders, np.array([r.least for r in ends], np.int64), np.array([r.largest for r in ends], np.int64))

    def codes(self, v: np.ndarray) -> np.ndarray:
        """Cell numbers, one byte each."""
        return np.stack([np.searchsorted(b, v[:, d], side="right") for d, b in enumerate(self.borders)], axis=1).astype(np.uint8)

    def tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest part of (x - c)^2 - (x - r)^2 per dimension, cell and centroid; linear in x, so the ends of a cell decide."""
        r = centroids.sum(axis=0) // len(centroids)
        u = (centroids - r).T[:, None, :]
        a, b = (u * u - 2 * (ends[:, :, None] - r[:, None, None]) * u for ends in (self.low, self.high))
        return np.minimum(a, b), np.maximum(a, b)


def open_choices(codes: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which centroids can be the nearest (rows x k): those whose lower bound does not exceed the least upper bound."""
    lower = np.zeros((len(codes), tables[0].shape[2]), np.int64)
    upper = np.zeros_like(lower)
    for d in range(codes.shape[1]):
        lower += tables[0][d][codes[:, d]]
        upper += tables[1][d][codes[:, d]]
    return lower <= upper.min(axis=1, keepdims=True)


def exact_choice(v: np.ndarray, choices: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance) among the open choices; of equal ones the smaller number."""
    distance = np.full(choices.shape, np.iinfo(np.int64).max)
    for c in range(len(centroids)):
        at = np.flatnonzero(choices[:, c])
        distance[at, c] = ((v[at] - centroids[c]) ** 2).sum(axis=1)
    best = distance.argmin(axis=1)
    return best, distance[np.arange(len(v)), best]


def nearest(v: np.ndarray, cells: Cells, tables: tuple[np.ndarray, np.ndarray], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells first, exact distances among what they leave open."""
    return exact_choice(v, open_choices(cells.codes(v), tables), centroids)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)


def _steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, _STEP):
        yield batch.slice(a, _STEP)


def _sums(frame: DataFrame, change, k: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts per cluster: ``change`` adds a batch to a task's own arrays, k (dim + 1) numbers leave each task."""
    def run(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in them:
            for part in _steps(batch):
                change(part, total, count)
        # The count of a cluster stands behind its sums.
        own = np.concatenate((total, count[:, None]), axis=1).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(own))), pa.array(own)], names=["at", "s"])

    both = np.zeros(k * (dim + 1), np.int64)
    for r in frame.mapInArrow(run, "at bigint, s bigint").groupBy("at").agg(F.sum("s").alias("s")).collect():
        both[r.at] = r.s
    both = both.reshape(k, dim + 1)
    return both[:, :dim], both[:, dim]


def _moved(centroids: np.ndarray, total: np.ndarray, count: np.ndarray) -> np.ndarray:
    """floor(sum / count) of every cluster with members; empty ones stay."""
    return np.where(count[:, None] > 0, total // np.maximum(count, 1)[:, None], centroids)


def fitted(vectors: DataFrame, cells: Cells, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The centroids after ``rounds`` rounds."""
    k, dim = centroids.shape
    if rounds < 1:
        return centroids
    tables = cells.tables(centroids)

    def everything(part: pa.RecordBatch, total: np.ndarray, count: np.ndarray) -> None:
        v = _matrix(part.column(0), dim)
        best, _ = nearest(v, cells, tables, centroids)
        np.add.at(total, best, v)
        count += np.bincount(best, minlength=k)

    total, count = _sums(vectors.select("v"), everything, k, dim)
    old, now = centroids, _moved(centroids, total, count)
    approximations = None
    for _ in range(rounds - 1):
        if (old == now).all():
            return now
        if approximations is None:
            approximations = cut(_coded(vectors, cells, dim))
        delta, moved = _sums(_asked(approximations, vectors, cells, old, now), _change(cells, old, now), k, dim)
        total, count = total + delta, count + moved
        old, now = now, _moved(now, total, count)
    return now


def _coded(vectors: DataFrame, cells: Cells, dim: int) -> DataFrame:
    """(row, cells): the approximations, a byte a dimension."""
    def run(them):
        for batch in them:
            for part in _steps(batch):
                codes = cells.codes(_matrix(part.column(1), dim))
                raw = pa.Array.from_buffers(pa.binary(dim), len(codes), [None, pa.py_buffer(codes.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), raw], names=["row", "cells"])

    return vectors.select("row", "v").mapInArrow(run, "row bigint, cells binary")


def _asked(approximations: DataFrame, vectors: DataFrame, cells: Cells, old: np.ndarray, now: np.ndarray) -> DataFrame:
    """The vectors that the intervals of both rounds do not settle in one and the same cluster."""
    before, after = cells.tables(old), cells.tables(now)

    def run(them):
        for batch in them:
            for part in _steps(batch):
                codes = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                a, b = open_choices(codes, before), open_choices(codes, after)
                stays = (a.sum(axis=1) == 1) & (b.sum(axis=1) == 1) & (a.argmax(axis=1) == b.argmax(axis=1))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(~stays))], names=["row"])

    rows = approximations.mapInArrow(run, "row bigint")
    return vectors.select("row", "v").join(rows, "row", "left_semi").select("v")


def _change(cells: Cells, old: np.ndarray, now: np.ndarray):
    before, after = cells.tables(old), cells.tables(now)

    def change(part: pa.RecordBatch, total: np.ndarray, count: np.ndarray) -> None:
        v = _matrix(part.column(0), old.shape[1])
        a, b = nearest(v, cells, before, old)[0], nearest(v, cells, after, now)[0]
        np.subtract.at(total, a, v)
        np.add.at(total, b, v)
        count += np.bincount(b, minlength=len(old)) - np.bincount(a, minlength=len(old))

    return change


def clustered(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
              dim: int = DIM, seed: int = SEED, scale: int = SCALE, bits: int = BITS) -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row per row of ``rows`` that takes part.

    Takes part: a vector of exactly ``dim`` components, none null or non-finite; others have no row. Repeated rows count each for
    itself; null ids are kept but start no cluster. Fewer vectors with an id than clusters: as many clusters as there are. No such
    vector with an id, or an empty table: an empty table. A component beyond 2^27 / scale raises an error, since its squared distances may not fit
    a long. Other columns are not read."""
    result = (f"`{id_col}` {rows.select(F.col(f'`{id_col}`')).schema[0].dataType.simpleString()}, cluster int, distance bigint, "
              "cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    vectors = whole_vectors(rows, id_col, vector, dim, scale)
    start = first_centroids(vectors, clusters, seed)
    if not len(start):
        return rows.sparkSession.createDataFrame([], result)
    cells = Cells.measured(vectors, dim, bits)
    centroids = fitted(vectors, cells, start, rounds)
    tables = cells.tables(centroids)

    def assign(them):
        for batch in them:
            for part in _steps(batch):
                best, distance = nearest(_matrix(part.column(1), dim), cells, tables, centroids)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best.astype(np.int32)), pa.array(distance)],
                                                 names=["id", "cluster", "distance"])

    kind = vectors.schema["id"].dataType.simpleString()
    placed = cut(vectors.select("id", "v").mapInArrow(assign, f"id {kind}, cluster int, distance bigint"))
    own = {r.cluster: r.d for r in placed.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    shas = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    per_cluster = rows.sparkSession.createDataFrame(
        [(c, d, sum(own.values()), shas[c]) for c, d in own.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return placed.join(F.broadcast(per_cluster), "cluster").select(  # one row per cluster
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
