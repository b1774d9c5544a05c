import hashlib
import math
import random

import numpy as np
import pytest
from helpers import SF, rows_of
from pyspark.sql import functions as F

from tally.llm import centroids, queries

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k, rounds, dims, scale, seed):
    """Lloyd over Python integers: rows (vec_id, q, cluster, distance), centroids."""
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [math.floor(scale * float(np.float32(x))) for x in v]))

    def start(r):
        h = hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else ""
        return (r[0] is None, h, r[1])
    cents = [q for _, q in sorted(kept, key=start)[:k]]

    def near(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(near(q)[1], []).append(q)
        for j, qs in groups.items():
            cents[j] = [sum(col) // len(qs) for col in zip(*qs)]
    return sorted(((i, near(q)[1], near(q)[0]) for i, q in kept), key=repr), cents


def cloud(n, dims, seed, spread=1.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss(3 * (i % 5 == j), spread) for j in range(dims)]) for i in range(n)]


@pytest.mark.parametrize("rows,k,dims", [
    (cloud(400, 12, 1), 8, 12),
    (cloud(50, 3, 2, 1e-3) + [(i, [0.5, 0.5, 0.5]) for i in range(200)], 8, 3),           # a third and more are one vector
    ([(i % 4, [float(i % 4 // 2), 1.0]) for i in range(40)], 8, 2),                       # ties and equal centroids
    ([(None, [1.0, 2.0]), (None, [1.0, 3.0]), (7, [0.0, 0.0])], 8, 2),                    # fewer than k, NULL ids
    ([(1, [60000.0, -60000.0]), (2, [-60000.0, 60000.0]), (3, [60000.0, -59999.999])], 2, 2),
    ([(5, [1.0, 1.0])], 8, 2),
])
def test_equal_to_lloyd_in_integers(spark, rows, k, dims):
    odd = [(901, None), (902, []), (903, [1.0] * (dims + 1)), (904, [None] + [0.0] * (dims - 1)),
           (905, [float("nan")] + [0.0] * (dims - 1)), (906, [float("-inf")] + [0.0] * (dims - 1))]
    df = spark.createDataFrame(rows + odd, SCHEMA).withColumn("cluster", F.lit("x")).withColumn("q", F.lit(1)).repartition(5)
    labels, cents = centroids.cluster(df, k, 10, dims, 1024.0, 3, lead=min(2, dims))
    want, want_cents = brute(rows, k, 10, dims, 1024.0, 3)
    assert cents.tolist() == want_cents
    assert rows_of(labels) == want


def test_the_bound_is_never_above_the_distance_and_saves_work():
    rng = np.random.default_rng(4)
    q = rng.integers(-3000, 3000, (2000, 24)) * np.array([9] * 3 + [1] * 21)
    c = q[:16].copy()
    directions = np.linalg.svd(np.cov(q.T))[0]
    turned = q @ directions
    near, rest = turned[:, :6], np.linalg.norm(turned[:, 6:], axis=1)
    f = centroids.Filter(c, directions, 6)
    exact = ((q[:, None, :] - c[None]) ** 2).sum(axis=2)
    size = np.linalg.norm(turned, axis=1)[:, None] + f.norm[None]
    assert (f.bounds(near, rest) <= exact + centroids.SLACK * size ** 2 + 1e-6).all()
    best, distance, verified = f.nearest(q, near, rest)
    assert (distance == exact.min(axis=1)).all() and (best == exact.argmin(axis=1)).all()
    assert verified < exact.size / 2


def test_no_kept_vector_gives_no_rows(spark):
    for rows in ([], [(1, None), (2, [1.0])]):
        labels, cents = centroids.cluster(spark.createDataFrame(rows, SCHEMA), 8, 10, 2)
        out = centroids.with_inertia(labels, cents)
        assert out.collect() == [] and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                                                       "centroid_sha256"]


def test_components_that_do_not_fit_raise(spark):
    with pytest.raises(Exception, match="would not fit a long"):
        centroids.cluster(spark.createDataFrame([(1, [1e9, 0.0]), (2, [0.0, 0.0])], SCHEMA), 8, 10, 2)


def test_query_sums_its_distances(spark):
    rows = queries.op13_centroids(spark, SF).collect()
    given = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, cents = brute(given, 8, 10, 64, 1024.0, 3)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in rows), key=repr) == want
    for r in rows:
        assert r["inertia"] == sum(w[2] for w in want)
        assert r["cluster_inertia"] == sum(w[2] for w in want if w[1] == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, cents[r["cluster"]])).encode()).hexdigest()
