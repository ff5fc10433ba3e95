"""Centroid clustering of integer vectors; few rotated coordinates rule centroids out, whole vectors decide.

A vector is stored with its leading coordinates in the principal axes of all vectors and the length of the rest. The
distance of the leading coordinates plus the squared difference of the two lengths is never above the true distance, so a
centroid with a bound beyond the best distance found needs no look at the 64 integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelscope.session import materialize

LEADING = 8
#: Integers beyond this are set to it: squared distances of 64 components then fit into 64 bits.
LIMIT = 1 << 27
#: Part of the squared lengths by which rounding may lift a bound; far above what 64 products of doubles can lose.
SLACK = 1e-9


def whole_numbers(vec: Column, scale: int) -> Column:
    """floor(scale * component), each component as double."""
    return F.transform(vec, lambda x: F.floor(F.least(F.greatest(F.lit(float(scale)) * x.cast("double"), F.lit(-float(LIMIT))), F.lit(float(LIMIT)))).cast("int"))


def usable(vec: Column, dims: int) -> Column:
    """True for a vector of so many components, all of them finite numbers."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(vec) == dims) & finite, F.lit(False))


def matrix(column: pa.ListArray, width: int, dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(-1, width)


def matrix_column(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def principal_axes(vectors: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and orthonormal axes of all vectors, widest first; sums of products come from the tasks, a row each."""

    def run(batches):
        n, s, ss = 0, np.zeros(dims), np.zeros((dims, dims))
        for b in batches:
            v = matrix(b.column(0), dims, float)
            n, s, ss = n + len(v), s + v.sum(0), ss + v.T @ v
        yield pa.RecordBatch.from_arrays([matrix_column(np.concatenate([[n], s, ss.ravel()])[None])], ["x"])

    sums = vectors.select("v").mapInArrow(run, "x array<double>").select(F.posexplode("x")).groupBy("pos").agg(F.sum("col").alias("x")).toPandas()
    x = np.zeros(1 + dims + dims * dims)
    x[sums.pos.to_numpy(int)] = sums.x
    n, mean = max(x[0], 1), x[1 : dims + 1] / max(x[0], 1)
    spread = x[dims + 1 :].reshape(dims, dims) / n - np.outer(mean, mean)
    return mean, np.linalg.eigh((spread + spread.T) / 2)[1][:, ::-1]


class Rotation:
    """Leading coordinates and length of the rest, of whole vectors."""

    def __init__(self, mean: np.ndarray, axes: np.ndarray, leading: int):
        self.mean, self.axes, self.leading = mean, axes, leading

    def __call__(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = (v - self.mean) @ self.axes
        return r[:, : self.leading], np.sqrt((r[:, self.leading :] ** 2).sum(1))


def rotated(vectors: DataFrame, rotation: Rotation, dims: int) -> DataFrame:
    """Vectors with ``lead`` and ``rest``."""

    def run(batches):
        for b in batches:
            lead, rest = rotation(matrix(b.column(1), dims, float))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), matrix_column(lead), pa.array(rest)], ["vec_id", "v", "lead", "rest"])

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<int>, lead array<double>, rest double")


def lower_bounds(lead: np.ndarray, rest: np.ndarray, c_lead: np.ndarray, c_rest: np.ndarray) -> np.ndarray:
    """A number not above the squared distance of each vector to each centroid."""
    low = ((lead[:, None, :] - c_lead[None]) ** 2).sum(2) + (rest[:, None] - c_rest[None]) ** 2
    return low - SLACK * (1 + ((lead**2).sum(1) + rest**2)[:, None] + ((c_lead**2).sum(1) + c_rest**2)[None])


def nearest(v: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, c_lead: np.ndarray, c_rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Cluster and exact squared distance of every vector, ties to the smaller number; and how many distances it took."""
    low = lower_bounds(lead, rest, c_lead, c_rest)
    cluster = low.argmin(1)
    exact = lambda rows, c: ((v[rows].astype(np.int64) - c) ** 2).sum(1)
    best, looked = exact(slice(None), centroids[cluster]), len(v)
    first = cluster.copy()
    for c in range(len(centroids)):
        rows = np.flatnonzero((low[:, c] <= best) & (first != c))
        d = exact(rows, centroids[c])
        looked += len(rows)
        won = (d < best[rows]) | ((d == best[rows]) & (c < cluster[rows]))
        best[rows[won]], cluster[rows[won]] = d[won], c
    return cluster, best, looked


def moved(vectors: DataFrame, rotation: Rotation, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: floor of the exact mean of their vectors; one without vectors stays.

    Tasks add up their own vectors, one row for each cluster; only these rows are shuffled.
    """
    dims = centroids.shape[1]
    around = (centroids, *rotation(centroids.astype(float)))

    def run(batches):
        n, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for b in batches:
            v = matrix(b.column(0), dims, np.int64)
            cluster, *_ = nearest(v, matrix(b.column(1), around[1].shape[1], float), b.column(2).to_numpy(), *around)
            n += np.bincount(cluster, minlength=len(centroids))
            for c in np.unique(cluster):
                sums[c] += v[cluster == c].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centroids))), matrix_column(np.c_[n, sums])], ["cluster", "x"])

    parts = vectors.select("v", "lead", "rest").mapInArrow(run, "cluster long, x array<long>").select("cluster", F.posexplode("x"))
    out = [[0] * (dims + 1) for _ in centroids]
    for r in parts.groupBy("cluster", "pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("x")).collect():
        out[r.cluster][r.pos] = int(r.x)
    return np.array([[s // n for s in sums] if n else old for (n, *sums), old in zip(out, centroids.tolist(), strict=True)], np.int64).reshape(centroids.shape)


def assigned(vectors: DataFrame, rotation: Rotation, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    around = (centroids, *rotation(centroids.astype(float)))

    def run(batches):
        for b in batches:
            cluster, d, _ = nearest(matrix(b.column(1), centroids.shape[1], np.int64), matrix(b.column(2), around[1].shape[1], float), b.column(3).to_numpy(), *around)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cluster.astype(np.int32)), pa.array(d)], ["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "v", "lead", "rest").mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, leading: int = LEADING) -> DataFrame:
    """Rows (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one for each usable vector.

    Centroids start as the k vectors whose ids have the smallest SHA-256 of ``1:<id>`` (a null id: ``1:``; equal ids in
    the order of their components), fewer if there are fewer vectors. Vectors that are null, of another length, or hold a
    null or non-finite component are left out; integers beyond 2^27 count as 2^27. Repeated rows are vectors of their
    own; other columns are left out, whatever their names; an empty table gives no rows. Every round is one pass without a
    shuffle of vectors, whatever the size of a cluster; the driver holds k centroids and the axes.
    """
    spark = vectors.sparkSession
    kept = vectors.where(usable(F.col(vec_col), dims)).select(F.col(id_col).cast("long").alias("vec_id"), whole_numbers(F.col(vec_col), scale).alias("v"))
    kept = materialize(kept)
    key = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    centroids = np.array([r.v for r in kept.orderBy(key, "v").limit(k).select("v").collect()], np.int64).reshape(-1, dims)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    rotation = Rotation(*principal_axes(kept, dims), leading)
    stored = materialize(rotated(kept, rotation, dims))
    for _ in range(rounds):
        centroids = moved(stored, rotation, centroids)
    last = materialize(assigned(stored, rotation, centroids))
    inertia = {r.cluster: int(r.d) for r in last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    rows = [(c, d, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in inertia.items()]
    facts = F.broadcast(spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return last.join(facts, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
