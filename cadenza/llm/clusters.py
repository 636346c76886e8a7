"""Centroid clustering of whole-number vectors: each row's nearest centroid by a tournament over bisecting planes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

#: Components after scaling stay within this, so that every sign test and distance of 64 components is exact in 64 bits.
MOST = 1 << 26


class Bisectors:
    """The planes half way between each two of ``centroids`` (k, dims), as whole numbers: one normal and threshold for each pair.

    A row x is nearer to j than to i if and only if ``2 (c_j - c_i) x > |c_j|^2 - |c_i|^2``.
    """

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        squares = (centroids * centroids).sum(1)
        self.normals = 2 * (centroids[None] - centroids[:, None])
        self.thresholds = squares[None] - squares[:, None]

    def winners(self, rows: np.ndarray) -> np.ndarray:
        """The nearest centroid of each row by k - 1 sign tests: the winner so far meets the next number; on zero it stays, being the smaller."""
        won = np.zeros(len(rows), np.intp)
        for j in range(1, len(self.centroids)):
            side = np.einsum("nd,nd->n", rows, self.normals[won, j]) - self.thresholds[won, j]
            won[side > 0] = j
        return won

    def distances(self, rows: np.ndarray, won: np.ndarray) -> np.ndarray:
        gap = rows - self.centroids[won]
        return np.einsum("nd,nd->n", gap, gap)


def finite(v: Column) -> Column:
    """Whether a vector is there and none of its components is null, NaN or infinite."""
    return F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def scaled(v: Column, scale: int) -> Column:
    """floor(scale * x) of each component x as a double; beyond MOST either way the job is refused, as its results could not be exact."""
    whole = lambda x: F.floor(x.cast("double") * F.lit(float(scale)))
    return F.transform(v, lambda x: F.when(F.abs(whole(x)) <= MOST, whole(x).cast("int")).otherwise(F.raise_error("a vector's component is too large to be scored exactly").cast("int")))


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(batch.column("v").flatten(), np.int64).reshape(batch.num_rows, -1)


def _moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: exact floors of the means of the rows that each wins; those that win none stay.

    A task sends one sum for each centroid and component, whatever its rows; the driver gets as many numbers as the centroids have.
    """
    planes = Bisectors(centroids)
    k, dims = centroids.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, dims + 1), np.int64)
        for b in batches:
            x = _rows(b)
            won = planes.winners(x)
            for j in np.unique(won).tolist():
                sums[j, :dims] += x[won == j].sum(0)
                sums[j, dims] += np.count_nonzero(won == j)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), dims + 1), pa.int32()), pa.array(np.tile(np.arange(dims + 1), k), pa.int32()), pa.array(sums.ravel())], ["cluster", "at", "total"])

    found = {(r["cluster"], r["at"]): int(r["total"]) for r in rows.select("v").mapInArrow(work, "cluster int, at int, total long").groupBy("cluster", "at").agg(F.sum("total").alias("total")).collect()}
    after = centroids.copy()
    for j in range(k):
        if n := found.get((j, dims), 0):
            after[j] = [found[j, at] // n for at in range(dims)]
    return after


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept row of ``vectors`` (vec_id, embedding).

    Rows with exactly ``dims`` components, none null or non-finite, are kept and turned into floor(``scale`` * x). The centroids
    start as the ``k`` rows of smallest sha256 of ``seed:vec_id``, in that order (all rows, if fewer; ties by vector). In each of ``rounds``
    every row goes to the nearest centroid (ties to the smaller number), and a centroid that has rows moves to the floor of
    their mean. After the last round rows are assigned once more, with their exact squared distance. Rounds end early only
    where no centroid has moved, as further ones would change nothing.

    A row without vec_id takes part but is no first centroid. Repeated rows count and come back as often as they stand; an
    empty table, or one that keeps no row, gives none; other columns are not read. A component beyond 65,536 (2^26 after scaling) is refused.
    The rows are stored once as whole numbers; of them the driver gets the k first and k sums a round.
    """
    v = F.col("embedding")
    kept = vectors.where((F.size(v) == dims) & finite(v)).select(F.col("vec_id").cast("long").alias("vec_id"), scaled(v, scale).alias("v"))
    rows = save(kept, "whole-vectors")
    spark = rows.sparkSession
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.where("vec_id is not null").select(name.alias("name"), "v").orderBy("name", "v").limit(k).collect()
    schema = "vec_id long, cluster int, distance long"
    if not first:
        return rows.limit(0).selectExpr("vec_id", "0 as cluster", "0L as distance", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256")
    centroids = np.array([r["v"] for r in first], np.int64).reshape(len(first), dims)
    for _ in range(rounds):
        before, centroids = centroids, _moved(rows, centroids)
        if (before == centroids).all():
            break
    planes = Bisectors(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _rows(b)
            won = planes.winners(x)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(won, pa.int32()), pa.array(planes.distances(x, won))], ["vec_id", "cluster", "distance"])

    assigned = save(rows.mapInArrow(assign, schema), "assigned")
    sums = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    every = sum(sums.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame([(j, sums[j], every, digests[j]) for j in sorted(sums)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
