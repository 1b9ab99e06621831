"""Centroid clustering of embeddings in exact integers, searched progressively in the Walsh-Hadamard domain.

Vectors become integers (floor of a fixed scale times each component), so
sums, means and distances are exact and the same on any number of tasks. A
vector and every centroid go through the same integer Walsh-Hadamard
transform, ordered coarse to fine (by the number of sign changes of the basis
row). The transform is orthogonal up to the factor DIM, so the squared
distance of two transforms is DIM times the squared distance of the vectors,
and any partial sum of squared coefficient differences is a lower bound of it.
The search takes the centroid with the least first coefficient gap, finishes
its distance, then adds coefficient blocks coarse to fine for the others and
drops a centroid once its partial sum is strictly above the best finished
distance; the survivors are finished on all DIM coefficients, so ties are
never dropped and go to the smaller centroid number.

Each round is one Spark job: tasks assign their vectors and return one row of
counts and componentwise sums per centroid (a map-side partial aggregate),
which a grouped sum merges in decimal(38,0). Only k centroids of DIM integers
reach the driver, a bound set by the parameters, not by the data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shotmetrics.operators.lineage import checkpointed

# Fixed values of the result contract: the vector width and the integer scale.
DIM = 64
SCALE = 1024

# Coefficients are compared in blocks of these sizes, coarse to fine.
BLOCKS = (1, 1, 2, 4, 8, 16, 32)


def walsh_basis(dim: int = DIM) -> np.ndarray:
    """The dim x dim +-1 Hadamard matrix (Sylvester), rows in order of sign changes."""
    h = np.ones((1, 1), dtype=np.int64)
    while h.shape[0] < dim:
        h = np.block([[h, h], [h, -h]])
    changes = (np.diff(h, axis=1) != 0).sum(axis=1)
    return h[np.argsort(changes, kind="stable")]


def transformed(vectors: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Exact integer transforms of the rows of vectors (int64)."""
    return vectors.astype(np.int64) @ basis.T


def nearest(vectors_t: np.ndarray, centroids_t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid, both from transforms.

    Ties go to the smaller number. Returns (cluster int32, distance int64) with
    the distance in the vectors' own units (the transform's is DIM times it).
    """
    n, k = vectors_t.shape[0], centroids_t.shape[0]
    if n == 0 or k == 0:
        return np.zeros(n, np.int32), np.zeros(n, np.int64)
    edges = np.cumsum((0, *BLOCKS))
    partial = np.zeros((n, k), dtype=np.int64)
    done = np.zeros((n, k), dtype=bool)
    # Coarsest coefficient of every pair, then one finished distance per row as the bound.
    gap = vectors_t[:, None, 0] - centroids_t[None, :, 0]
    partial += gap * gap
    first = np.argmin(partial, axis=1)
    rows = np.arange(n)
    rest = vectors_t[:, 1:] - centroids_t[first, 1:]
    partial[rows, first] += (rest * rest).sum(axis=1)
    done[rows, first] = True
    bound = partial[rows, first].copy()
    alive = partial <= bound[:, None]
    for lo, hi in zip(edges[1:-1], edges[2:], strict=True):
        todo = alive & ~done
        r, c = np.nonzero(todo)
        if len(r) == 0:
            break
        d = vectors_t[r, lo:hi] - centroids_t[c, lo:hi]
        partial[r, c] += (d * d).sum(axis=1)
        alive &= partial <= bound[:, None]
    # Survivors now hold all DIM coefficients; the eliminated are strictly worse than the bound.
    scores = np.where(alive, partial, np.iinfo(np.int64).max)
    cluster = np.argmin(scores, axis=1)
    return cluster.astype(np.int32), partial[rows, cluster] // DIM


def integer_vectors(embeddings: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, v): rows whose vector has exactly DIM finite components, each floor(SCALE * x) as a long.

    Null vectors, other widths, and null, NaN or infinite components drop the
    row; repeated rows stay as they are. Only the two named columns are read,
    so other columns, of any name, play no part.
    """
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    return embeddings.where(x.isNotNull() & (F.size(x) == DIM) & finite).select(
        F.col(key).alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("bigint")).alias("v")
    )


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors of least lowercase-hex sha256 of '<seed>:<vec_id>', ties by the vector; at most k rows reach the driver."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    top = vectors.orderBy(rank.asc_nulls_last(), F.col("v").asc()).limit(k).collect()
    return [list(r.v) for r in top]


def _sums(centroids: np.ndarray):
    basis = walsh_basis()
    centroids_t = transformed(centroids, basis)
    k = len(centroids)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(k, dtype=np.int64)
        sums = [[0] * DIM for _ in range(k)]
        for frame in frames:
            if frame.empty:
                continue
            v = np.stack(frame["v"].to_numpy()).astype(np.int64)
            cluster, _ = nearest(transformed(v, basis), centroids_t)
            counts += np.bincount(cluster, minlength=k)
            for c in np.unique(cluster):
                part = v[cluster == c].sum(axis=0, dtype=object)
                sums[c] = [a + int(b) for a, b in zip(sums[c], part, strict=True)]
        rows = [(c, int(counts[c]), [str(s) for s in sums[c]]) for c in range(k) if counts[c]]
        yield pd.DataFrame(rows, columns=["cluster", "n", "sums"])

    return assign


def lloyd(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3) -> list[list[int]]:
    """Centroids after `rounds` of assignment and exact floor(sum / count) updates; empty clusters keep theirs.

    Fewer than k vectors give as many centroids as vectors; no vectors give none.
    """
    centroids = first_centroids(vectors, k, seed)
    for _ in range(rounds):
        if not centroids:
            break
        parts = vectors.select("v").mapInPandas(_sums(np.array(centroids, dtype=np.int64)), "cluster int, n long, sums array<string>")
        merged = parts.groupBy("cluster").agg(
            F.sum("n").alias("n"),
            F.array(*[F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(DIM)]).alias("sums"),
        )
        for r in merged.collect():
            centroids[r.cluster] = [int(s) // r.n for s in r.sums]
    return centroids


def _final(centroids: np.ndarray):
    basis = walsh_basis()
    centroids_t = transformed(centroids, basis)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                yield pd.DataFrame({"vec_id": pd.Series([], "Int64"), "cluster": pd.Series([], "int32"), "distance": pd.Series([], "int64")})
                continue
            v = np.stack(frame["v"].to_numpy()).astype(np.int64)
            cluster, distance = nearest(transformed(v, basis), centroids_t)
            yield pd.DataFrame({"vec_id": frame["vec_id"].astype("Int64"), "cluster": cluster, "distance": distance})

    return assign


def centroid_sha256(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(str(c) for c in centroid).encode()).hexdigest()


def clustered(embeddings: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    The integer vectors are written once to the shared checkpoint folder, so
    every round and a lost executor read them back instead of the source.
    Per-cluster sums come from a grouped aggregate of k rows, joined back by
    broadcast (k rows); no window spans a cluster. An empty table gives no rows.
    """
    vectors = checkpointed(integer_vectors(embeddings))
    spark = vectors.sparkSession
    centroids = lloyd(vectors, k, rounds, seed)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    assigned = vectors.mapInPandas(_final(np.array(centroids, dtype=np.int64)), "vec_id long, cluster int, distance long")
    per_cluster = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    hashes = spark.createDataFrame([(i, centroid_sha256(c)) for i, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    # k rows: a total over them is a window over k rows, and both sides of the joins hold k rows.
    per_cluster = per_cluster.join(F.broadcast(hashes), "cluster").withColumn(
        "inertia", F.sum("cluster_inertia").over(Window.partitionBy())
    )
    return assigned.join(F.broadcast(per_cluster), "cluster").select(
        "vec_id", "cluster", "distance", F.col("cluster_inertia").cast("bigint"), F.col("inertia").cast("bigint"), "centroid_sha256"
    )
