"""Centroid clustering with Orchard's search (operator 12).

The centroids are few and travel to every task with, for each of them, the other ones sorted by distance. A vector starts
at some centroid and walks down its list; a closer centroid takes over with its own list; visited ones are skipped; the walk
ends strictly beyond twice the current distance, since nothing there can be as near. All arithmetic is on whole numbers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import written
from .vectors import matrix, packed

MAX_CENTROIDS = 2048  # the sorted lists of all pairs, which are broadcast, take 16 bytes a pair: 64 MB
BATCH = 4096


class Orchard:
    """Nearest centroids of many vectors, walked in step."""

    def __init__(self, centroids: np.ndarray):
        c = centroids.astype(np.int64)
        self.centroids = c
        gaps = np.empty((len(c), len(c)), np.int64)
        for k in range(len(c)):
            gaps[k] = ((c - c[k]) ** 2).sum(axis=1)
        self.order = np.argsort(gaps, axis=1, kind="stable")  # at equal distance the smaller number first
        self.gaps = np.take_along_axis(gaps, self.order, axis=1)
        norms = np.sqrt((c**2).sum(axis=1))
        self.by_norm = np.argsort(norms, kind="stable")
        self.norms = norms[self.by_norm]

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each vector's nearest centroid, the smaller number at equal distance."""
        parts = [self._walk(vectors[k : k + BATCH].astype(np.int64)) for k in range(0, len(vectors), BATCH)]
        return (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _walk(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, k = len(v), len(self.centroids)
        # The walk may start anywhere; a centroid of about the vector's length is often near.
        near = np.searchsorted(self.norms, np.sqrt((v**2).sum(axis=1)))
        best = self.by_norm[np.minimum(near, k - 1)].copy()
        distance = ((v - self.centroids[best]) ** 2).sum(axis=1)
        visited = np.zeros((n, k), bool)
        visited[np.arange(n), best] = True
        place = np.zeros(n, np.int64)
        live = np.arange(n)
        while len(live):
            at, own = place[live], best[live]
            ended = at >= k
            gap = self.gaps[own, np.minimum(at, k - 1)]
            # distances, not squares: gap > 2 d is gap^2 > 4 d^2; at exactly twice, a centroid may be as near
            live = live[~(ended | (gap > 4 * distance[live]))]
            if not len(live):
                break
            other = self.order[best[live], place[live]]
            place[live] += 1
            fresh = ~visited[live, other]
            who, other = live[fresh], other[fresh]
            visited[who, other] = True
            d = ((v[who] - self.centroids[other]) ** 2).sum(axis=1)
            closer = (d < distance[who]) | ((d == distance[who]) & (other < best[who]))
            who, other, d = who[closer], other[closer], d[closer]
            best[who], distance[who], place[who] = other, d, 0
        return best, distance


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest sha256 of `seed:<id>`; null ids last, ties by the vector."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    rows = vectors.select(key.alias("key"), "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(k).collect()
    return np.array([np.frombuffer(r.v, "<i4") for r in rows], np.int64).reshape(len(rows), -1 if rows else 0)


def centroid_sums(vectors: DataFrame, search, dims: int) -> DataFrame:
    """(cluster, dim, total, n) with one row for each cluster and component. Each task sends its own sums, at most k rows."""

    def run(batches):
        nearest = search.value
        k = len(nearest.centroids)
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            v = matrix(batch.column("v"), dims)
            best, _ = nearest.nearest(v)
            counts += np.bincount(best, minlength=k)
            order = np.argsort(best, kind="stable")
            found, starts = np.unique(best[order], return_index=True)
            if len(found):
                sums[found] += np.add.reduceat(v[order].astype(np.int64), starts, axis=0)
        own = np.flatnonzero(counts)
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(counts[own]), pa.array(list(sums[own]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = vectors.select("v").mapInArrow(run, "cluster int, n long, sums array<long>")
    long = parts.select("cluster", "n", F.posexplode("sums").alias("dim", "total"))
    return long.groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def train(vectors: DataFrame, k: int, rounds: int, dims: int, seed: str) -> np.ndarray:
    """Centroids (whole numbers) after `rounds` rounds over vectors(id, v). Each round reads the vectors once; k * dims sums come
    to the driver. Fewer vectors than k: as many centroids as vectors."""
    centroids = first_centroids(vectors, k, seed)
    context = vectors.sparkSession.sparkContext
    for _ in range(rounds if len(centroids) else 0):
        search = context.broadcast(Orchard(centroids))
        for r in centroid_sums(vectors, search, dims).collect():
            centroids[r.cluster, r.dim] = r.total // r.n  # floors, below zero too
        search.unpersist()
    return centroids


def cluster(df: DataFrame, k: int, rounds: int, dims: int, id_column: str = "vec_id", vector: str = "embedding", seed: str = "2") -> DataFrame:
    """df(id, vector array<float or double>, ...) -> the id, cluster int, distance long (squared), cluster_inertia and inertia
    long (distance summed over the cluster and over all) and centroid_sha256 (of the components as text, joined by commas).

    Vectors become floor(256 * x). Left out: vectors that are null, of another size, or with a null or non-finite component.
    Starts are told by the id's hash, so equal rows may make equal centroids; of these the smaller number takes all. A null
    id is a vector as any other, but starts last. Empty clusters keep their centroid. Empty table: empty result. Other columns
    may have any name. ValueError: k above MAX_CENTROIDS (pairs of centroids are broadcast); components of 2^16 or more.
    """
    if not 1 <= k <= MAX_CENTROIDS:
        raise ValueError(f"k must lie in 1..{MAX_CENTROIDS}")
    spark = df.sparkSession
    vectors = written(packed(df, {"id": F.col(id_column)}, vector, dims))
    centroids = train(vectors, k, rounds, dims, seed)
    search = spark.sparkContext.broadcast(Orchard(centroids))

    def run(batches):
        for batch in batches:
            best, distance = search.value.nearest(matrix(batch.column("v"), dims))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(best, pa.int32()), pa.array(distance)], ["id", "cluster", "distance"])

    kind = vectors.schema["id"].dataType.simpleString()
    assigned = written(vectors.select("id", "v").mapInArrow(run, f"id {kind}, cluster int, distance long"))
    inertia = {r[0]: r[1] for r in assigned.groupBy("cluster").agg(F.sum("distance")).collect()}  # at most k rows
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(c, s, sum(inertia.values()), hashes[c]) for c, s in inertia.items()]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select(F.col("id").alias(id_column), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
