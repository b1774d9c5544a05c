"""Clustering (K1-K6) on Spark ML.

K-means (k-means|| start) and bisecting k-means are distributed fits.
Agglomerative clustering is re-aimed for scale: exact agglomeration of all
rows is quadratic, so pass 1 reduces the rows to ``micro`` k-means
centroids on Spark (count and mean per micro cluster), pass 2 runs Ward
merges on those bounded summaries, and the micro -> cluster map (``micro``
rows) is broadcast back to label every row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.functions.stats import as_col, nan_to_null, run_parallel


def vectors(df: DataFrame, xs: Sequence[str], key: Sequence[str], scale: bool = True) -> DataFrame:
    """key..., xs..., features (divided by their standard deviation when
    ``scale``); rows with a NULL or NaN feature are skipped (VectorAssembler
    rejects them).  Features are not mean-centred: k-means and PCA do not need it,
    and bisecting k-means splits a cluster by perturbing its centre in
    proportion to the centre's norm, so a centre at the origin never splits."""
    xs, key = list(xs), list(key)
    base = df.select(*[as_col(k) for k in key], *[nan_to_null(x).alias(x) for x in xs]).na.drop(subset=[f"`{x}`" for x in xs])
    cols = [f"_x{i}" for i in range(len(xs))]
    base = base.select("*", *[as_col(x).alias(c) for x, c in zip(xs, cols)])
    v = VectorAssembler(inputCols=cols, outputCol="_raw" if scale else "features").transform(base).drop(*cols)
    if scale:
        v = StandardScaler(inputCol="_raw", outputCol="features", withMean=False, withStd=True).fit(v).transform(v)
        v = v.drop("_raw")
    return v


# --------------------------------------------------------------------- K1
def kmeans(df: DataFrame, xs: Sequence[str], k: int, key: Sequence[str], seed: int = 42,
           scale: bool = True, max_iter: int = 20) -> DataFrame:
    """Assignment table: key..., xs..., cluster."""
    v = vectors(df, xs, key, scale)
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="features", predictionCol="cluster").fit(v)
    return model.transform(v).withColumn("cluster", F.col("cluster").cast("long")).drop("features")


# --------------------------------------------------------------------- K2
def hierarchical(df: DataFrame, xs: Sequence[str], k: int, key: Sequence[str], seed: int = 42,
                 scale: bool = True) -> DataFrame:
    """Divisive hierarchical clustering (bisecting k-means)."""
    v = vectors(df, xs, key, scale)
    model = BisectingKMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(v)
    return model.transform(v).withColumn("cluster", F.col("cluster").cast("long")).drop("features")


# --------------------------------------------------------------------- K3
LINKAGES = ("ward", "average", "complete", "single")


def merges_of(centroids: np.ndarray, sizes: np.ndarray, linkage: str = "ward") -> list[tuple[int, int, float, int]]:
    """The full agglomeration of weighted centroids: per step the two groups
    that merge (each named by its smallest member), their distance, and the
    rows of the merged group.  Distances follow the Lance-Williams update;
    Ward's is the increase of the within-group sum of squares.  The input is
    bounded by the micro-cluster count."""
    if linkage not in LINKAGES:
        raise ValueError(f"linkage must be one of {LINKAGES}")
    size = sizes.astype("float64").copy()
    m = len(size)
    d = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(-1).astype("float64")
    d = d * size[:, None] * size[None, :] / (size[:, None] + size[None, :]) if linkage == "ward" else np.sqrt(d)
    np.fill_diagonal(d, np.inf)
    merges = []
    for _ in range(m - 1):
        a, b = sorted(int(x) for x in np.unravel_index(np.argmin(d), d.shape))
        cost, na, nb = float(d[a, b]), size[a], size[b]
        other = np.isfinite(d[a]) & np.isfinite(d[b])
        if linkage == "ward":
            row = ((na + size) * d[a] + (nb + size) * d[b] - size * cost) / (na + nb + size)
        elif linkage == "average":
            row = (na * d[a] + nb * d[b]) / (na + nb)
        else:
            row = (np.maximum if linkage == "complete" else np.minimum)(d[a], d[b])
        d[a] = d[:, a] = np.where(other, row, np.inf)
        d[b] = d[:, b] = np.inf
        size[a] = na + nb
        merges.append((a, b, cost, int(na + nb)))
    return merges


def ward_merges(centroids: np.ndarray, sizes: np.ndarray, k: int, linkage: str = "ward") -> tuple[np.ndarray, list[tuple]]:
    """Agglomeration of weighted centroids down to ``k`` groups: the group of
    each centroid (numbered by descending size, then smallest member) and the
    merges that were made (step, a, b, cost)."""
    m = len(sizes)
    group = np.arange(m)
    done = merges_of(centroids, sizes, linkage)[:max(m - k, 0)]
    for a, b, _, _ in done:
        group[group == b] = a
    total = {r: float(sizes[group == r].sum()) for r in set(group.tolist())}
    remap = {r: i for i, r in enumerate(sorted(total, key=lambda r: (-total[r], r)))}
    return np.array([remap[g] for g in group]), [(i, a, b, cost) for i, (a, b, cost, _) in enumerate(done)]


def _micro(df: DataFrame, xs: Sequence[str], key: Sequence[str], micro: int, seed: int, scale: bool):
    """Rows with their micro cluster, and the micro clusters' numbers, centroids and sizes (at most ``micro``)."""
    v = vectors(df, xs, key, scale).persist()
    km = KMeans(k=micro, seed=seed, maxIter=30, featuresCol="features", predictionCol="micro").fit(v)
    assigned = km.transform(v)
    summ = (assigned.groupBy("micro")
            .agg(F.count(F.lit(1)).alias("n"),
                 *[F.avg(vector_to_array("features")[i]).alias(f"_c{i}") for i in range(len(xs))])
            .orderBy("micro").collect())  # at most ``micro`` rows
    v.unpersist()  # cached for the micro k-means; labelling re-reads by lineage
    return (assigned, [int(r["micro"]) for r in summ],
            np.array([[r[f"_c{i}"] for i in range(len(xs))] for r in summ]), np.array([r["n"] for r in summ]))


def agglomerative(df: DataFrame, xs: Sequence[str], k: int, key: Sequence[str], micro: int = 200,
                  seed: int = 42, scale: bool = True, linkage: str = "ward") -> DataFrame:
    """Agglomerative clustering at scale: key..., xs..., micro, cluster."""
    assigned, ids, cent, sizes = _micro(df, xs, key, micro, seed, scale)
    groups, _ = ward_merges(cent, sizes, k, linkage)
    mapping = df.sparkSession.createDataFrame([(m, int(g)) for m, g in zip(ids, groups)], "micro long, cluster long")
    return (assigned.withColumn("micro", F.col("micro").cast("long"))
            .join(F.broadcast(mapping), on="micro", how="inner").drop("features"))


def merge_table(df: DataFrame, xs: Sequence[str], key: Sequence[str], micro: int = 200, seed: int = 42,
                scale: bool = True, linkage: str = "ward") -> DataFrame:
    """The dendrogram over the micro clusters: (step, a, b, distance, size),
    one row per merge, groups named by their smallest micro cluster."""
    _, ids, cent, sizes = _micro(df, xs, key, micro, seed, scale)
    rows = [(i, ids[a], ids[b], d, n) for i, (a, b, d, n) in enumerate(merges_of(cent, sizes, linkage))]
    return df.sparkSession.createDataFrame(rows, "step long, a long, b long, distance double, size long")


# --------------------------------------------------------------------- K4
def choose_k(df: DataFrame, xs: Sequence[str], k_values: Sequence[int], key: Sequence[str] = (),
             seed: int = 42, scale: bool = True, parallelism: int = 4) -> DataFrame:
    """(k, inertia, silhouette) per candidate k.  The vector frame is cached
    and the fits run as concurrent Spark jobs; the silhouette is Spark's
    squared-Euclidean form, linear in the number of rows (no pairwise
    distances)."""
    v = vectors(df, xs, key, scale).persist()
    ev = ClusteringEvaluator(featuresCol="features", predictionCol="cluster", metricName="silhouette",
                             distanceMeasure="squaredEuclidean")

    def one(k):
        model = KMeans(k=k, seed=seed, maxIter=20, featuresCol="features", predictionCol="cluster").fit(v)
        return (int(k), float(model.summary.trainingCost), float(ev.evaluate(model.transform(v))))

    rows = run_parallel(one, k_values, parallelism)
    v.unpersist()
    return df.sparkSession.createDataFrame(rows, "k long, inertia double, silhouette double")


def reference_rows(spark: SparkSession, n: int, low: Sequence[float], high: Sequence[float], seed: int) -> DataFrame:
    """``n`` rows with ``features`` drawn evenly from the box between ``low`` and ``high``.
    A row's values are hashes of its number and the seed, so a lost partition is drawn again alike."""
    def draw(j: int, a: float, b: float):
        u = F.shiftrightunsigned(F.xxhash64("id", F.lit(seed), F.lit(j)), 11) / F.lit(float(1 << 53))
        return (F.lit(a) + u * F.lit(b - a)).alias(f"_x{j}")

    rows = spark.range(n).select(*[draw(j, float(a), float(b)) for j, (a, b) in enumerate(zip(low, high))])
    return VectorAssembler(inputCols=rows.columns, outputCol="features").transform(rows).select("features")


def gap_statistic(df: DataFrame, xs: Sequence[str], k_values: Sequence[int], references: int = 10, seed: int = 42,
                  scale: bool = True, rotate: bool = True, parallelism: int = 4) -> DataFrame:
    """(k, log_w, reference_log_w, gap, s, chosen): the logarithm of the k-means dispersion
    against its mean over ``references`` tables without clusters.

    A reference table has as many rows as the data, drawn evenly from the box
    around them, with ``rotate`` the box along the principal axes (long
    diagonal data fill their own box badly).  ``s`` is the deviation over the
    references times sqrt(1 + 1 / references); ``chosen`` marks the smallest k
    whose gap reaches the next k's gap less that one's ``s`` (none does: the k of
    the largest gap).  One cluster (k = 1) is allowed.  No dispersion at all
    (at most k distinct rows) has the logarithm and the gap NULL and is not chosen; a table
    without rows gives NULLs throughout.  Work: one k-means fit per k and table;
    nothing but the dispersions reaches the driver.  The data are cached as plain numbers and reference
    rows drawn again on each pass (either is cheaper than reading cached vectors); a fit holds its rows as
    blocks of numbers."""
    ks = sorted({int(k) for k in k_values})
    if not ks or ks[0] < 1 or references < 2:
        raise ValueError("give values of k from 1 on and at least 2 references")
    spark = df.sparkSession
    cols = [f"c{i}" for i in range(len(xs))]
    held = df.select(*[nan_to_null(x).alias(c) for x, c in zip(xs, cols)]).na.drop(how="any").persist()
    stats = Summarizer.metrics("count", "variance", "min", "max").summary(F.col("features"))

    def summary(t: DataFrame):
        return t.agg(stats.alias("s")).first()["s"]  # a few numbers per feature

    def log_w(t: DataFrame, k: int, about) -> float | None:
        if k == 1:
            w = float(sum(about["variance"].toArray())) * (about["count"] - 1)
        else:
            fit = KMeans(k=k, seed=seed, maxIter=30, featuresCol="features", solver="block")
            try:
                w = float(fit.fit(t).summary.trainingCost)
            except Py4JJavaError:  # blocks cannot do with a start of fewer than k distinct rows
                w = 0.0
            # blocks take distances from products of rows and centres, which cancel where rows are near each
            # other for their distance from the origin; rows one by one are exact there
            far = np.maximum(np.abs(about["min"].toArray()), np.abs(about["max"].toArray()))
            if not w > 1e-9 * about["count"] * float(far @ far):
                w = float(fit.setSolver("row").fit(t).summary.trainingCost)
        return math.log(w) if w > 0 else None

    try:
        if held.isEmpty():
            return spark.createDataFrame([(k, None, None, None, None, False) for k in ks], _GAP)
        v = vectors(held, cols, (), scale).select("features")
        if rotate and len(xs) > 1:
            v = PCA(k=len(xs), inputCol="features", outputCol="_pc").fit(v).transform(v).select(
                F.col("_pc").alias("features"))
        about = summary(v)
        own_log = dict(zip(ks, run_parallel(lambda k: log_w(v, k, about), ks, parallelism)))

        def reference(b: int) -> list[float | None]:
            t = reference_rows(spark, about["count"], about["min"], about["max"], seed * 1_000_003 + b)
            of = summary(t)
            return [log_w(t, k, of) for k in ks]

        drawn = run_parallel(reference, range(references), parallelism)
    finally:
        held.unpersist()
    rows = []
    for i, k in enumerate(ks):
        logs = [r[i] for r in drawn]
        if own_log[k] is None or None in logs:
            rows.append([k, own_log[k], None, None, None])
        else:
            rows.append([k, own_log[k], float(np.mean(logs)), float(np.mean(logs)) - own_log[k],
                         float(np.std(logs)) * math.sqrt(1 + 1 / references)])
    known = [r for r in rows if r[3] is not None]
    reached = [a[0] for a, b in zip(known, known[1:]) if a[3] >= b[3] - b[4]]
    best = reached[0] if reached else max(known, key=lambda r: r[3])[0] if known else None
    return spark.createDataFrame([(*r, r[0] == best) for r in rows], _GAP)


_GAP = "k long, log_w double, reference_log_w double, gap double, s double, chosen boolean"


# --------------------------------------------------------------------- K5
def cluster_scatter(assigned: DataFrame, xs: Sequence[str], key: Sequence[str], cluster: str = "cluster",
                    sample_every: int = 1, scale: bool = True) -> DataFrame:
    """Two principal components per row for a cluster scatter plot.
    ``sample_every`` = m keeps rows whose key hashes to 0 mod m (repeatable;
    the caller states it)."""
    key = list(key)
    v = vectors(assigned, xs, [*key, cluster], scale)
    pca = PCA(k=2, inputCol="features", outputCol="_pc").fit(v)
    out = pca.transform(v).select(*key, F.col(cluster).alias("cluster"),
                                  vector_to_array("_pc")[0].alias("pc1"), vector_to_array("_pc")[1].alias("pc2"))
    if sample_every > 1:
        out = out.where(F.pmod(F.xxhash64(*[F.col(k) for k in key]), F.lit(sample_every)) == 0)
    return out


# --------------------------------------------------------------------- K6
def cluster_profile(assigned: DataFrame, xs: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Size, share and mean of each feature per cluster."""
    per = assigned.groupBy(F.col(cluster).alias("cluster")).agg(
        F.count(F.lit(1)).alias("size"), *[F.avg(F.col(x).cast("double")).alias(f"mean_{x}") for x in xs])
    tot = per.agg(F.sum("size").alias("_tot"))
    return per.crossJoin(F.broadcast(tot)).select(
        "cluster", "size", (F.col("size") / F.col("_tot")).alias("share"), *[f"mean_{x}" for x in xs])
