"""Centroid clustering in exact integers, with an n-simplex projection that rules out most centroids.

Each vector's distances to a few pivots are computed once and kept. With the pivots' distances to each other they fix a simplex whose
base are the pivots and whose apex is the vector: the base is laid into few dimensions by a Cholesky factor, the apex's
coordinates there solve a triangular system, and its height over the base comes last. Between two apexes on one side of the base
the Euclidean distance is a lower bound of the true one; with one apex mirrored through the base it is an upper bound. A centroid
whose lower bound is above the smallest upper bound of all centroids can't be the nearest one; the others are compared in exact
integers. Bounds are computed in floating point, so a margin far above their rounding error is added.

A round sends the centroids to the tasks (k rows of d integers) and gets one row of sums per cluster and task back, which are
added up before the driver sees k rows. No vector moves after it has been written with its apex.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.base import keep

#: Contract: components, scale, centroids, rounds. Pivots; vectors that they are picked from, at most.
WIDTH, SCALE, CENTROIDS, ROUNDS, PIVOTS, SAMPLE = 64, 256, 40, 5, 16, 4_096
#: Components beyond this take its value: a squared distance then always fits into 63 bits.
LARGEST = 1 << 27
#: Margin of the bounds, as a share of the squared lengths that they come from.
MARGIN = 1e-7


def whole(vectors: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """vec_id, x (array<bigint>): floor(scale * component) of the vectors with width components, none null or non-finite."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(F.size("v") == width)
    v = v.where(F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    most = F.lit(float(LARGEST))
    return v.select("vec_id", F.transform("v", lambda x: F.floor(F.greatest(F.least(x * float(scale), most), -most)).cast("long")).alias("x"))


def first_centroids(x: DataFrame, k: int) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of 2:vec_id, in its order; a null id counts as empty, rows with one id go by their
    components."""
    mark = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r["x"] for r in x.orderBy(mark, "x").limit(k).collect()], np.int64)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to one row y."""
    d = x - y
    return np.einsum("ij,ij->i", d, d)


class Simplex:
    """The base over pivots, and the apexes of vectors over it."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        between = np.array([squares(pivots, p) for p in pivots], float)
        self.own = between[0, 1:]
        self.base = np.linalg.cholesky((self.own[:, None] + self.own[None, :] - between[1:, 1:]) / 2) if len(pivots) > 1 else np.zeros((0, 0))
        self.inverse = np.linalg.inv(self.base)

    def apexes(self, x: np.ndarray) -> np.ndarray:
        """Coordinates in the base, and the height last, from squared distances to the pivots alone."""
        far = np.stack([squares(x, p) for p in self.pivots], axis=1).astype(float)
        flat = (far[:, :1] + self.own - far[:, 1:]) / 2 @ self.inverse.T
        height = np.sqrt(np.maximum(far[:, 0] - (flat * flat).sum(axis=1), 0))
        return np.column_stack([flat, height])


def pick_pivots(x: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows of x, each as high as possible over the base of those before; none that lies close to it."""
    picked = [0]
    left = squares(x, x[0]).astype(float)
    flat = np.zeros((len(x), 0))
    span = left.max(initial=0)
    while len(picked) < n:
        at = int(np.argmax(left))
        if left[at] <= 1e-4 * span or not span:
            break
        # The next coordinate of every row, along the height of the new pivot.
        dot = (squares(x, x[0]) + float(squares(x[at : at + 1], x[0])[0]) - squares(x, x[at])) / 2
        more = (dot - flat @ flat[at]) / np.sqrt(left[at])
        flat = np.column_stack([flat, more])
        left = np.maximum(left - more * more, 0)
        picked.append(at)
    return x[picked]


def possible(apex: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Which of centroids (apexes too) may be nearest to each apex, by lower and upper bounds."""
    flat = (apex[:, :-1] ** 2).sum(axis=1)[:, None] + (centroids[:, :-1] ** 2).sum(axis=1)[None] - 2 * apex[:, :-1] @ centroids[:, :-1].T
    low = flat + (apex[:, -1:] - centroids[None, :, -1]) ** 2
    high = flat + (apex[:, -1:] + centroids[None, :, -1]) ** 2
    slack = MARGIN * ((apex**2).sum(axis=1)[:, None] + (centroids**2).sum(axis=1)[None]) + 1
    return low - slack <= (high + slack).min(axis=1, keepdims=True)


def nearest(x: np.ndarray, apex: np.ndarray, centroids: np.ndarray, simplex: Simplex) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row of x and its exact squared distance; ties to the smaller number."""
    maybe = possible(apex, simplex.apexes(centroids))
    best, own = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int32)
    for c in range(len(centroids)):
        rows = np.flatnonzero(maybe[:, c])
        d = squares(x[rows], centroids[c])
        better = d < best[rows]
        best[rows[better]], own[rows[better]] = d[better], c
    return own, best


def _matrix(column: pa.Array, kind) -> np.ndarray:
    flat = np.asarray(column.flatten()).astype(kind, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), kind)


def projected(x: DataFrame, simplex: Simplex) -> DataFrame:
    """vec_id, x, apex of every row."""
    kind = x.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            apex = simplex.apexes(_matrix(b.column(1), np.int64)) if b.num_rows else np.zeros((0, 1))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(apex) + 1) * apex.shape[1], pa.int32()), pa.array(apex.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), flat], names=["vec_id", "x", "apex"])

    return x.mapInArrow(run, f"vec_id {kind}, x array<bigint>, apex array<double>")


def summed(data: DataFrame, centroids: np.ndarray, simplex: Simplex) -> dict[int, tuple[int, list[int]]]:
    """By number of each cluster that has vectors: how many, and their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, object)
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0), np.int64)
                own, _ = nearest(x, _matrix(b.column(1), float), centroids, simplex)
                n += np.bincount(own, minlength=len(n))
                for c in np.unique(own):
                    total[c] += x[own == c].sum(axis=0)
        some = np.flatnonzero(n)
        sums = pa.array([[str(v) for v in total[c]] for c in some], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), sums], names=["cluster", "n", "sums"])

    parts = data.select("x", "apex").mapInArrow(run, "cluster int, n bigint, sums array<string>")
    whole_sums = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(centroids.shape[1])]
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *whole_sums).collect()  # at most one row per centroid
    return {r["cluster"]: (r["n"], [int(r[f"s{i}"]) for i in range(centroids.shape[1])]) for r in rows}


def cluster(vectors: DataFrame, width: int = WIDTH, scale: int = SCALE, k: int = CENTROIDS, rounds: int = ROUNDS, pivots: int = PIVOTS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every vector that whole() takes.

    With fewer than k vectors each starts a centroid; without any there are no rows. Rows that repeat a vec_id are vectors of their
    own, null ids too. Centroids without vectors stay where they are. Components beyond 2**27 after scaling are taken as that,
    so that distances fit; inertias are null beyond 63 bits. Other columns are ignored.
    """
    x = whole(vectors, width, scale)
    kind = x.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    centroids = first_centroids(x, k)
    if not len(centroids):
        return x.sparkSession.createDataFrame([], schema)
    sample = np.array([r["x"] for r in x.select("x").orderBy(F.xxhash64("x"), "x").limit(SAMPLE).collect()], np.int64)
    simplex = Simplex(pick_pivots(sample, pivots))
    data = keep(projected(x, simplex))
    for _ in range(rounds):
        for c, (n, sums) in summed(data, centroids, simplex).items():
            centroids[c] = [s // n for s in sums]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own, far = nearest(_matrix(b.column(1), np.int64), _matrix(b.column(2), float), centroids, simplex)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.int32()), pa.array(far)], names=["vec_id", "cluster", "distance"])

    assigned = keep(data.mapInArrow(assign, f"vec_id {kind}, cluster int, distance bigint"))
    by = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda v: v if v < 1 << 63 else None
    names = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    told = [(c, fits(s), fits(sum(by.values())), names[c]) for c, s in by.items()]  # at most k rows
    side = x.sparkSession.createDataFrame(told, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(side), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
