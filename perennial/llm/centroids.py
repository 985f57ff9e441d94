"""Centroid clustering of integer vectors, each assignment an Orchard search.

The centroids go to every task with, for each of them, all others sorted by their distance from it.  A
vector starts at a centroid and walks down that centroid's list; as soon as a listed centroid is closer,
the walk goes on at the top of the closer one's list.  Centroids met before are passed over, and the walk
ends where the next listed centroid lies strictly beyond twice the present distance: by the triangle
inequality neither it nor any later one can be closer, nor as close.  All vectors of a block take each
step together.  Distances are squared and exact, so the bound is four times the present distance.

A round sends at most one row per task, cluster and dimension through a shuffle, and ``k`` centroids to
the driver and back: memory there is bounded by ``k`` times the dimensions, whatever the data's size.

Rules for special cases: vectors of another length, null vectors and those with a null or non-finite
component are left out; a component beyond ``bound(size)`` counts as the bound, so that squared
distances fit a ``long`` (sums of distances beyond a ``long`` are the largest ``long``); a null key hashes
as empty text; repeated rows each count; of fewer than ``k`` vectors all are centroids, equal ones too
(the smaller number wins); equal hashes at the start are ordered by their vectors; without vectors the
result is empty.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perennial.functions.storage import materialize

#: Vectors that walk together.
BLOCK = 4096
_LONGEST = (1 << 63) - 1


def bound(size: int) -> int:
    """The largest components of vectors of some size whose squared distances fit a ``long``."""
    return isqrt((1 << 62) // size) // 2


def integer_vectors(
    vectors: DataFrame, size: int, scale: int, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``vec_id`` and ``point``: ``floor(scale * x)`` of each component of the complete vectors."""
    parts = F.col("parts")
    fit = (F.size(parts) == size) & F.forall(
        parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    )
    most = float(bound(size))
    bounded = F.transform(
        parts, lambda x: F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(F.lit(float(scale)) * x))).cast("long")
    )
    rows = vectors.select(F.col(f"`{key}`").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("parts"))
    return rows.where(F.coalesce(fit, F.lit(False))).select("vec_id", bounded.alias("point"))


def first_centroids(points: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` points of smallest sha256 of seed, colon and key."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = points.orderBy(drawn, "point").limit(k).collect()
    return np.array([r["point"] for r in rows], np.int64)


# --- Orchard search --------------------------------------------------------------------------


def _kind(points: np.ndarray, centroids: np.ndarray):
    """The narrowest integers that hold the squared distances."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    return np.int32 if 4 * most * most * centroids.shape[1] < 1 << 29 else np.int64


class Orchard:
    """Neighbour lists of some centroids, and the search for the nearest one."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        k = len(centroids)
        self.lists = np.empty((k, max(0, k - 1)), np.int32)
        self.apart = np.empty((k, max(0, k - 1)), np.int64)
        for c in range(k):
            away = ((centroids - centroids[c]) ** 2).sum(axis=1)
            order = np.argsort(away, kind="stable")
            self.lists[c] = order[order != c]
            self.apart[c] = away[self.lists[c]]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid of each point; of equals the smallest."""
        number, distance = np.empty(len(points), np.int32), np.empty(len(points), np.int64)
        for lo in range(0, len(points), BLOCK):
            number[lo : lo + BLOCK], distance[lo : lo + BLOCK] = self._walk(points[lo : lo + BLOCK])
        return number, distance

    def _walk(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = _kind(points, self.centroids)
        points, centroids = points.astype(kind), self.centroids.astype(kind)
        n, k = len(points), len(centroids)

        def away(rows, listed):
            gap = points[rows] - centroids[listed]
            return np.einsum("ij,ij->i", gap, gap).astype(np.int64)

        best = np.zeros(n, np.int32)
        distance = away(np.arange(n), best)
        met = np.zeros((n, k), bool)
        met[:, 0] = True
        place = np.zeros(n, np.int32)
        walking = np.arange(n) if k > 1 else np.zeros(0, np.int64)
        while len(walking):
            at, list_ = place[walking], best[walking]
            on = self.apart[list_, at] // 4 <= distance[walking] - (self.apart[list_, at] % 4 > 0)
            walking, at, list_ = walking[on], at[on], list_[on]
            listed = self.lists[list_, at]
            place[walking] = at + 1
            new = np.flatnonzero(~met[walking, listed])
            rows, listed = walking[new], listed[new]
            met[rows, listed] = True
            found = away(rows, listed)
            closer = (found < distance[rows]) | (found == distance[rows]) & (listed < best[rows])
            rows = rows[closer]
            best[rows], distance[rows], place[rows] = listed[closer], found[closer], 0
            walking = walking[place[walking] < k - 1]
        return best, distance


def _points(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.int64)


def _sums(orchard: Orchard):
    size = orchard.centroids.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros(len(orchard.centroids), np.int64), np.zeros(orchard.centroids.shape, np.int64)
        for batch in batches:
            points = _points(batch.column(0), size)
            if not len(points):
                continue
            number, _ = orchard.nearest(points)
            order = np.argsort(number, kind="stable")
            there, first = np.unique(number[order], return_index=True)
            totals[there] += np.add.reduceat(points[order], first, axis=0)
            counts += np.bincount(number, minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(counts[some]), pa.array(list(totals[some]), pa.list_(pa.int64()))],
            names=["cluster", "n", "total"],
        )

    return add


def next_centroids(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every non-empty centroid becomes the floor of the mean of its points, exactly."""
    parts = points.select("point").mapInArrow(_sums(Orchard(centroids)), "cluster int, n long, total array<long>")
    exact = "decimal(38,0)"
    sums = (
        parts.select("cluster", "n", F.posexplode("total").alias("place", "x"))
        .groupBy("cluster", "place")
        .agg(F.sum(F.col("n").cast(exact)).alias("n"), F.sum(F.col("x").cast(exact)).alias("x"))
    )
    out = centroids.copy()
    for r in sums.collect():
        out[r["cluster"], r["place"]] = int(r["x"]) // int(r["n"])
    return out


def assign(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id``, ``cluster``, ``distance`` (squared) of every point."""
    orchard = Orchard(centroids)
    size = centroids.shape[1]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, distance = orchard.nearest(_points(batch.column(1), size))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(number), pa.array(distance)], names=["vec_id", "cluster", "distance"]
            )

    kind = points.schema["vec_id"].dataType.simpleString()
    return points.select("vec_id", "point").mapInArrow(search, f"vec_id {kind}, cluster int, distance long")


def cluster_vectors(
    vectors: DataFrame,
    size: int = 64,
    scale: int = 256,
    k: int = 40,
    rounds: int = 5,
    seed: str = "2",
    key: str = "vec_id",
    vector: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """The assignment of all vectors after some rounds, stored (see ``assign``), and the centroids.

    The integer vectors are stored once and read by every round.
    """
    points = materialize(integer_vectors(vectors, size, scale, key, vector), "points")
    centroids = first_centroids(points, k, seed).reshape(-1, size)
    if not len(centroids):
        return points.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        centroids = next_centroids(points, centroids)
    return materialize(assign(points, centroids), "assigned"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add ``cluster_inertia`` and ``inertia`` (sums of distances) and each centroid's digest."""
    sums = {
        r["cluster"]: int(r["x"])
        for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x")).collect()
    }
    whole = min(sum(sums.values()), _LONGEST)
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    rows = [(c, min(sums.get(c, 0), _LONGEST), whole, d) for c, d in enumerate(digests)]
    of_cluster = assigned.sparkSession.createDataFrame(
        rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return assigned.join(F.broadcast(of_cluster), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
