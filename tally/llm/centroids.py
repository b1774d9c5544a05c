"""Centroid clustering (Lloyd's rounds) in exact integers, with a PCA-rotated filter.

The kept vectors are written once with their integer components, the leading
``lead`` coordinates in the basis of their principal components, and the norm
of the remaining coordinates.  For a vector and a centroid the squared distance
of the leading coordinates plus the squared difference of the two residual
norms is never more than the squared distance, so a centroid whose bound is
above the distance to a verified one is out; the survivors are verified in
64-bit integers.  The bound only saves work: ties and results are exact.

A task sums its own vectors per centroid, so a round moves (tasks x centroids)
rows and collects one row per centroid.  The driver holds the centroids and the
``dims x dims`` basis, nothing that grows with the rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, materialize, with_python

#: Components stay below this, so that the squared distance of up to 256 of them fits a long.
LIMIT = 1 << 26
#: Rounding of the rotated coordinates, relative to the squared norms; the bound is lowered by it.
SLACK = 1e-9


def quantized(vectors: DataFrame, dims: int, scale: float, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(vec_id, q)``: the vectors of exactly ``dims`` finite components as integers ``floor(scale * x)``."""
    v = F.col(f"`{vector}`").cast("array<double>")
    whole = v.isNotNull() & (F.size(v) == dims) & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    q = F.transform(v, lambda x: F.when(F.abs(x * scale) < LIMIT, F.floor(x * scale)).otherwise(
        F.raise_error(F.lit(f"a component times {scale} is {LIMIT} or more: distances would not fit a long"))))
    return vectors.where(whole).select(F.col(f"`{vec_id}`").alias("vec_id"), q.cast("array<bigint>").alias("q"))


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:vec_id``, in that order (NULL ids last,
    equal ids by their components)."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h")
    rows = kept.select(order, "q").orderBy(F.col("h").asc_nulls_last(), "q").limit(k).collect()
    return np.array([r["q"] for r in rows], dtype=np.int64)


def basis(kept: DataFrame, dims: int) -> np.ndarray:
    """Orthonormal principal directions, the one of most variance first (``dims x dims``)."""
    if len(kept.take(2)) < 2:
        return np.eye(dims)
    model = PCA(k=dims, inputCol="v", outputCol="p").fit(kept.select(array_to_vector("q").alias("v")))
    return model.pc.toArray()


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def store(kept: DataFrame, directions: np.ndarray, lead: int) -> DataFrame:
    """Write ``(vec_id, q, near, rest)``: leading rotated coordinates and the norm of the others."""
    dims = len(directions)
    schema = T.StructType([*kept.schema, T.StructField("near", T.ArrayType(T.DoubleType())),
                           T.StructField("rest", T.DoubleType())])

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            turned = _matrix(b.column(1), dims).astype(np.float64) @ directions
            near = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(turned[:, :lead]).ravel()), lead)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), near.cast(pa.list_(pa.float64())),
                 pa.array(np.linalg.norm(turned[:, lead:], axis=1))], names=["vec_id", "q", "near", "rest"])

    return materialize(with_python(kept).mapInArrow(rotate, schema), "centroids-store")


class Filter:
    """Nearest centroids of a batch of vectors: bounds first, integers for what they leave."""

    def __init__(self, centroids: np.ndarray, directions: np.ndarray, lead: int) -> None:
        turned = centroids.astype(np.float64) @ directions
        self.centroids, self.near = centroids, turned[:, :lead]
        self.rest, self.norm = np.linalg.norm(turned[:, lead:], axis=1), np.linalg.norm(turned, axis=1)

    def bounds(self, near: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Squared lower bounds, vectors x centroids."""
        return np.stack([((near - c) ** 2).sum(axis=1) + (rest - r) ** 2 for c, r in zip(self.near, self.rest)], axis=1)

    def nearest(self, q: np.ndarray, near: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of the nearest centroid (ties: the smaller), squared distance, and how many distances were verified."""
        low = self.bounds(near, rest)
        best = low.argmin(axis=1)
        distance = ((q - self.centroids[best]) ** 2).sum(axis=1)
        verified = len(q)
        size = np.sqrt((near ** 2).sum(axis=1) + rest ** 2)
        first = best.copy()
        for j, c in enumerate(self.centroids):
            rows = np.flatnonzero((low[:, j] <= distance + SLACK * (size + self.norm[j]) ** 2 + 1e-6) & (first != j))
            verified += len(rows)
            d = ((q[rows] - c) ** 2).sum(axis=1)
            closer = (d < distance[rows]) | ((d == distance[rows]) & (j < best[rows]))
            best[rows[closer]], distance[rows[closer]] = j, d[closer]
        return best, distance, verified


def _columns(b: pa.RecordBatch, dims: int, lead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _matrix(b.column("q"), dims), _matrix(b.column("near"), lead), b.column("rest").to_numpy(zero_copy_only=False)


def next_centroids(stored: DataFrame, centroids: np.ndarray, directions: np.ndarray, lead: int) -> np.ndarray:
    """One round: every non-empty centroid becomes the floor of its vectors' means."""
    k, dims = centroids.shape
    near = Filter(centroids, directions, lead)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for b in batches:
            q, lead_of, rest = _columns(b, dims, lead)
            best, _, _ = near.nearest(q, lead_of, rest)
            np.add.at(total, best, q)
            count += np.bincount(best, minlength=k)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(list(total[some]), pa.list_(pa.int64()))],
            names=["cluster", "n", "total"])

    parts = with_python(stored.select("q", "near", "rest")).mapInArrow(sums, "cluster int, n long, total array<bigint>")
    whole = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[
        F.sum(F.col("total")[i].cast("decimal(38,0)")) for i in range(dims)]).alias("total"))
    out = centroids.copy()
    for r in whole.collect():  # one row per centroid
        out[r["cluster"]] = [int(t) // r["n"] for t in r["total"]]
    return out


def assign(stored: DataFrame, centroids: np.ndarray, directions: np.ndarray, lead: int) -> DataFrame:
    """``(vec_id, cluster, distance)`` of every stored vector."""
    dims = centroids.shape[1]
    near = Filter(centroids, directions, lead)
    schema = T.StructType([stored.schema["vec_id"], T.StructField("cluster", T.IntegerType()),
                           T.StructField("distance", T.LongType())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, distance, _ = near.nearest(*_columns(b, dims, lead))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(distance)],
                                             names=schema.names)

    return with_python(stored).mapInArrow(label, schema)


def cluster(vectors: DataFrame, k: int, rounds: int, dims: int, scale: float = 1024.0, seed: int = 0, lead: int = 16,
            vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """``rounds`` of Lloyd over the kept vectors: ``(labels, centroids)`` where labels are
    ``vec_id, cluster, distance`` (squared, integer), written to the shared folder.

    Vectors that are NULL, of another length, or hold a NULL, NaN or infinite component are left
    out; other columns are not read, so their names may clash.  Repeated rows count as often as
    they occur, repeated ids are vectors of their own.  A NULL id is kept and starts a centroid
    only when no other is left.  Fewer kept vectors than ``k``: that many centroids.  No kept
    vector: no rows, no centroids.  Vectors have ``dims`` components whatever else a row holds, so
    there is no very long case; a component whose scaled size reaches ``LIMIT`` raises.  Equal
    centroids: the smaller number takes the vectors, the other stays as it is."""
    lead = min(lead, dims)
    kept = quantized(vectors, dims, scale, vec_id, vector)
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    directions = basis(kept, dims)
    stored = store(kept, directions, lead)
    for _ in range(rounds):
        moved = next_centroids(stored, centroids, directions, lead)
        if (moved == centroids).all():  # every further round would repeat this one
            break
        centroids = moved
    labels = materialize(assign(stored, centroids, directions, lead), "centroids-labels")
    forget(stored)
    return labels, centroids


def with_inertia(labels: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds ``cluster_inertia``, ``inertia`` (sums of squared distances) and ``centroid_sha256``."""
    if not len(centroids):
        return labels.select("*", F.col("distance").alias("cluster_inertia"), F.col("distance").alias("inertia"),
                             F.lit("").alias("centroid_sha256"))
    found = labels.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    per = {r["cluster"]: int(r["s"]) for r in found}  # one row per centroid
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]

    def pick(values: list):
        return F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)

    return labels.select("*", pick([per.get(j, 0) for j in range(len(centroids))]).cast("long").alias("cluster_inertia"),
                         F.lit(sum(per.values())).cast("long").alias("inertia"), pick(digests).alias("centroid_sha256"))
