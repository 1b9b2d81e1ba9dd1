"""Operator 11: k-means over integer vectors, assigned by the threshold algorithm.

Each dimension keeps its centroids in a list sorted by their value.  A vector enters all lists at its
own value and walks outward, taking from every list the nearest centroid not yet taken.  A centroid
met for the first time gets its exact squared distance.  One not met yet lies, in every dimension, at
least as far as what that list gave last, so the sum of these frontier distances bounds it from
below; a vector stops when the sum strictly exceeds its best distance (an equal sum may still hide
a tie of a smaller number).  The vectors of a batch walk in step, in numpy.

A round is one pass over the table: tasks send the count and the componentwise sums of their own
vectors for each centroid, Spark adds them up exactly, and k x dims sums reach the driver.  The
centroids (k x dims integers, whatever the number of vectors) travel with the tasks.

A vector counts if it has exactly ``dims`` components, none null or non-finite; x becomes
floor(scale * x).  A null vec_id is never a first centroid unless there are too few others, and is returned like any
other; repeated rows each count, and as first centroids they are equal, so the smaller number takes
both.  With fewer vectors than centroids there are as many centroids as vectors; an empty table gives
an empty result.  Extra columns are left out.  A component beyond 2^27 in size is refused with an
error, since squared distances would not fit 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, ship

ship(__name__)

CENTROIDS, ROUNDS, SCALE, DIMS = 16, 3, 64, 64
#: Largest size of a component, so that squared distances fit 64 bits.
LIMIT = 1 << 27
#: Numbers that a step holds for each of its arrays.
CELLS = 1 << 19


def whole(vector: str, dims: int) -> Column:
    """True for vectors of ``dims`` finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dims) & fine, F.lit(False))


def integers(column: pa.ListArray, scale: int) -> np.ndarray:
    """A row of floor(scale * x) for each vector of equal lengths."""
    flat = np.floor(pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False) * scale)
    if flat.size and np.abs(flat).max() > LIMIT:
        raise ValueError(f"a component exceeds {LIMIT} after scaling")
    return flat.astype(np.int64).reshape(len(column), -1 if len(column) else 0)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of each vector; ties go to the smaller number."""
    n, dims = x.shape
    k = len(centroids)
    order = np.argsort(centroids, axis=0, kind="stable").T  # a list of centroid numbers for each dimension
    lists = np.take_along_axis(centroids.T, order, axis=1)
    right = np.empty((n, dims), np.int64)
    for d in range(dims):
        right[:, d] = np.searchsorted(lists[d], x[:, d])
    left = right - 1
    best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, k, np.int64)
    seen = np.zeros((n, k), bool)
    active = np.arange(n)
    dim = np.arange(dims)
    far = np.int64(1) << np.int64(40)
    for _ in range(k):
        at, lo, hi = x[active], left[active], right[active]
        below = np.where(lo >= 0, at - lists[dim, np.maximum(lo, 0)], far)
        above = np.where(hi < k, lists[dim, np.minimum(hi, k - 1)] - at, far)
        down = below <= above
        taken = order[dim, np.where(down, lo, hi)]
        left[active], right[active] = lo - down, hi + ~down
        fresh = np.zeros((len(active), k), bool)
        fresh[np.arange(len(active))[:, None], taken] = True
        fresh &= ~seen[active]
        rows, numbers = np.nonzero(fresh)  # by row, then by number
        seen[active[rows], numbers] = True
        exact = np.full((len(active), k), np.iinfo(np.int64).max)
        for i in range(0, len(rows), step := max(1, CELLS // dims)):
            r, c = rows[i : i + step], numbers[i : i + step]
            exact[r, c] = ((at[r] - centroids[c]) ** 2).sum(axis=1)
        c = exact.argmin(axis=1)
        d = exact[np.arange(len(active)), c]
        old, was = best[active], number[active]
        better = (d < old) | ((d == old) & (c < was))
        best[active], number[active] = np.where(better, d, old), np.where(better, c, was)
        frontier = (np.where(down, below, above) ** 2).sum(axis=1)
        active = active[frontier <= best[active]]
        if not len(active):
            break
    return number, best


def in_steps(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, step := 4096):
            part = batch.slice(at, step)
            yield part, integers(part.column("vector"), scale)


def next_centroids(rows: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """The centroids after one round."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, x in in_steps(batches, scale):
            number, _ = nearest(x, centroids)
            counts += np.bincount(number, minlength=k)
            np.add.at(sums, number, x)
        cluster, dim = np.divmod(np.arange(k * dims), dims)
        yield pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(dim), pa.array(counts[cluster]), pa.array(sums.ravel())], ["cluster", "dim", "n", "total"])

    parts = rows.select("vector").mapInArrow(run, "cluster bigint, dim bigint, n bigint, total bigint")
    exact = parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = centroids.copy()
    for r in exact.filter("n > 0").collect():  # k x dims rows
        out[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
    return out


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS, vector: str = "embedding") -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = vectors.filter(whole(vector, dims)).select("vec_id", F.col(vector).alias("vector"))
    key = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(key.asc_nulls_last(), "vec_id", "vector").limit(k).collect()  # k rows
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string".replace("vec_id long", f"vec_id {kind}")
    if not first:
        return vectors.sparkSession.createDataFrame([], schema)
    centroids = integers(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), scale)
    for _ in range(rounds):
        centroids = next_centroids(rows, centroids, scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in in_steps(batches, scale):
            number, distance = nearest(x, centroids)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    placed = durable(rows.mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint"))
    inertia = {r["cluster"]: r["s"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    total = sum(inertia.values())
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    side = vectors.sparkSession.createDataFrame([(c, s, total, sha[c]) for c, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(side), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
