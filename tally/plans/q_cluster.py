"""Registered queries K1-K6 (clustering) on customer recency / frequency /
monetary features derived from the whole orders table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tally.operators import cluster as K
from tally.operators import linkage as L
from tally.plans.catalog import register
from tally.plans.fixtures import CUSTOMER_RFM_SQL, customer_rfm
from tally.session import written
from tally.sources.files import read_table

RFM = ["frequency", "monetary", "recency"]


@register("k1_kmeans")
def k1(spark, sf):
    return K.kmeans(customer_rfm(spark, sf), RFM, k=3, key=["custkey"])


@register("k2_hierarchical")
def k2(spark, sf):
    return K.hierarchical(customer_rfm(spark, sf), RFM, k=3, key=["custkey"])


@register("k3_agglomerative")
def k3(spark, sf):
    return K.agglomerative(customer_rfm(spark, sf), RFM, k=3, key=["custkey"], micro=50)


@register("k3_merge_table")
def k3_merges(spark, sf):
    return K.merge_table(customer_rfm(spark, sf), RFM, key=["custkey"], micro=50, linkage="average")


@register("k3_single_linkage_merges")
def k3_single_merges(spark, sf):
    return L.single_linkage(customer_rfm(spark, sf), RFM, "custkey")


@register("k3_single_linkage")
def k3_single(spark, sf):
    rfm = customer_rfm(spark, sf)
    return L.cut(written(L.single_linkage(rfm, RFM, "custkey"), "k3-merges"), rfm.select("custkey"), k=3)


@register("k4_choose_k")
def k4(spark, sf):
    return K.choose_k(customer_rfm(spark, sf), RFM, [2, 3, 4, 5, 6], key=["custkey"])


@register("k4_gap_statistic")
def k4_gap(spark, sf):
    return K.gap_statistic(customer_rfm(spark, sf), RFM, [1, 2, 3, 4, 5], references=5)


@register("k5_cluster_scatter")
def k5(spark, sf):
    assigned = K.kmeans(customer_rfm(spark, sf), RFM, k=3, key=["custkey"])
    return K.cluster_scatter(assigned, RFM, key=["custkey"])


@register("k6_cluster_profile_kmeans")
def k6_kmeans(spark, sf):
    return K.cluster_profile(K.kmeans(customer_rfm(spark, sf), RFM, k=3, key=["custkey"]), RFM)


# rule-based label (market segment) so SQL can check the profile exactly
_K6_SQL = (f"WITH a AS (SELECT r.*, c.c_mktsegment AS cluster FROM {CUSTOMER_RFM_SQL} AS r "
           "JOIN customer AS c ON c.c_custkey = r.custkey), "
           "p AS (SELECT cluster, count(*) AS size, avg(frequency) AS mean_frequency, avg(monetary) AS mean_monetary, "
           "avg(recency) AS mean_recency FROM a GROUP BY cluster) "
           "SELECT cluster, size, size / sum(size) OVER () AS share, mean_frequency, mean_monetary, mean_recency FROM p")


@register("k6_cluster_profile", _K6_SQL, ["share", "mean_frequency", "mean_monetary", "mean_recency"])
def k6(spark, sf):
    c = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"),
                                                 F.col("c_mktsegment").alias("cluster"))
    return K.cluster_profile(customer_rfm(spark, sf).join(c, on="custkey"), RFM)
