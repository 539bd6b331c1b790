"""Centroid clustering (Lloyd rounds) in integers, nearest by a bisector tournament.

Vectors of exactly ``dims`` components, none null or non-finite, are kept; each
component x becomes the integer floor(scale * x). For every centroid pair a < b
the bisector is precomputed: normal 2 (c_b - c_a) and threshold |c_b|^2 - |c_a|^2.
x is nearer to b if and only if normal . x passes the threshold; at equality the
smaller number stays. One centroid after another meets the winner so far, so k - 1
sign tests leave the nearest, the smallest number of equally near ones, and only
its squared distance is computed. All of it is 64-bit integer arithmetic.

The start is the ``k`` kept vectors of the smallest SHA-256 of ``seed:vec_id``
(null ids last, ties by the vector); with fewer kept vectors there are fewer
centroids. A round assigns every vector and moves each centroid that has some to
floor(sum / count) per component, exact and rounded down also below zero; empty
ones stay. A task emits one partial sum per centroid and component, so a cluster
that holds most rows is no hot key, and the driver sees k x dims sums a round.

Repeated rows and equal vectors each count. Null ids stay. A vector with a
component beyond ``LIMIT`` in size would leave 64 bits: the job ends with an
error that names the limit, as no exact result of type long exists. No vector
kept, or an empty table: an empty result. Other columns are not read, whatever
their names; the operator has no texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from triageflow.llm.common import bound_batches, stored

CLUSTERS = 16
ROUNDS = 3
DIMS = 64
SCALE = 64
SEED = "1"
#: |component| of an integer vector: 64 squares of a difference stay under 2^62.
LIMIT = 1 << 27


def integers(vectors: pa.Array, dims: int = DIMS, scale: int = SCALE) -> np.ndarray:
    """Integer vectors of a batch, one row each."""
    x = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims))
    if x.size and np.abs(x).max() > LIMIT:
        raise ValueError(f"a component beyond {LIMIT} / {scale}: distances would pass 64 bits")
    return x.astype(np.int64)


class Tournament:
    """Bisectors of all centroid pairs."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        norms = (centroids * centroids).sum(1)
        self.normals = 2 * (centroids[None, :, :] - centroids[:, None, :])
        self.thresholds = norms[None, :] - norms[:, None]

    def winners(self, x: np.ndarray) -> np.ndarray:
        best = np.zeros(len(x), np.int64)
        for b in range(1, len(self.centroids)):
            side = np.einsum("ij,ij->i", x, self.normals[best, b]) - self.thresholds[best, b]
            best = np.where(side > 0, b, best)
        return best

    def distances(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        off = x - self.centroids[cluster]
        return np.einsum("ij,ij->i", off, off)


def kept(df: DataFrame, vec_id: str, embedding: str, dims: int = DIMS) -> DataFrame:
    """``vec_id, embedding`` of the vectors that take part."""
    e = F.col(embedding)
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return df.where((F.size(e) == dims) & ~bad).select(F.col(vec_id).alias("vec_id"), e.alias("embedding"))


def first_centroids(rows: DataFrame, k: int, dims: int, scale: int, seed: str) -> np.ndarray:
    named = rows.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    first = named.orderBy(F.col("h").asc_nulls_last(), "embedding").limit(k).select("embedding").toArrow()
    return integers(first["embedding"].combine_chunks(), dims, scale) if len(first) else np.zeros((0, dims), np.int64)


def moved(rows: DataFrame, centroids: np.ndarray, dims: int, scale: int) -> np.ndarray:
    """Centroids after one round over all rows."""
    game = Tournament(centroids)

    def sums(batches):
        total, n = np.zeros_like(game.centroids), np.zeros(len(game.centroids), np.int64)
        for batch in batches:
            x = integers(batch.column("embedding"), dims, scale)
            cluster = game.winners(x)
            for c in np.unique(cluster):
                own = x[cluster == c]
                total[c] += own.sum(0)
                n[c] += len(own)
        c, d = np.nonzero(np.repeat(n[:, None] > 0, dims, 1))
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(d), pa.array(total[c, d]), pa.array(n[c])], names=["c", "d", "s", "n"])

    exact = lambda x: F.sum(F.col(x).cast("decimal(19,0)"))
    found = rows.select("embedding").mapInArrow(sums, "c bigint, d bigint, s bigint, n bigint").groupBy("c", "d").agg(exact("s").alias("s"), exact("n").alias("n"))
    out = centroids.copy()
    for r in found.collect():  # k x dims rows
        out[r.c, r.d] = int(r.s) // int(r.n)
    return out


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def clustered(spark: SparkSession, df: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE,
              seed: str = SEED, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` of every kept vector after ``rounds`` moves
    and a last assignment, written once, and the final centroids."""
    bound_batches(spark)
    rows = kept(df, vec_id, embedding, dims)
    centroids = first_centroids(rows, k, dims, scale, seed)
    if not len(centroids):
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")).limit(0), centroids
    for _ in range(rounds):
        centroids = moved(rows, centroids, dims, scale)
    game = Tournament(centroids)

    def assigned(batches):
        for batch in batches:
            x = integers(batch.column("embedding"), dims, scale)
            cluster = game.winners(x)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(game.distances(x, cluster))],
                                             names=["vec_id", "cluster", "distance"])

    schema = StructType([rows.schema["vec_id"], StructField("cluster", IntegerType()), StructField("distance", LongType())])
    return stored(spark, rows.mapInArrow(assigned, schema), "assigned"), centroids


def with_inertia(spark: SparkSession, assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds ``cluster_inertia``, ``inertia`` and ``centroid_sha256``: one row per
    cluster (at most k) is joined back."""
    per = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).cast("bigint").alias("i")).collect()
    total = sum(r.i for r in per)
    table = spark.createDataFrame([(r.cluster, r.i, total, digest(centroids[r.cluster])) for r in per],
                                  "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
