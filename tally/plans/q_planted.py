"""Registered queries over tables with a known structure, so that fits and
clusterings have an answer that SQL can state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tally.functions.stats import hash_bucket
from tally.operators import cluster as K
from tally.operators import evaluate as M
from tally.operators import linkage as L
from tally.operators import regress as R
from tally.operators import timeseries as TS
from tally.plans.catalog import register
from tally.plans.fixtures import BLOBS_SQL, blobs, doc_labels
from tally.plans.q_timeseries import _H, _M, _W, TS_COL, monthly_revenue
from tally.session import written
from tally.sources.files import read_table

XY = ["x", "y"]
# the four groups, whatever numbers they are given
_GROUPS = (f"SELECT size, size / sum(size) OVER () AS share, mean_x, mean_y FROM (SELECT count(*) AS size, avg(x) AS mean_x, "
           f"avg(y) AS mean_y FROM {BLOBS_SQL} AS b GROUP BY g)")
_GROUP_COLS = ["share", "mean_x", "mean_y"]


@register("k1_kmeans_planted", _GROUPS, _GROUP_COLS)
def k1(spark, sf):
    return K.cluster_profile(K.kmeans(blobs(spark, sf), XY, 4, ["id"]), XY).drop("cluster")


@register("k2_hierarchical_planted", _GROUPS, _GROUP_COLS)
def k2(spark, sf):
    return K.cluster_profile(K.hierarchical(blobs(spark, sf), XY, 4, ["id"]), XY).drop("cluster")


def _k3(linkage):
    return lambda spark, sf: K.cluster_profile(
        K.agglomerative(blobs(spark, sf), XY, 4, ["id"], micro=24, linkage=linkage), XY).drop("cluster")


for _linkage in K.LINKAGES:
    register(f"k3_agglomerative_{_linkage}_planted", _GROUPS, _GROUP_COLS)(_k3(_linkage))


@register("k3_single_linkage_planted", _GROUPS, _GROUP_COLS)
def k3_single(spark, sf):
    """Exact single linkage of all rows, cut where four groups are left."""
    b = blobs(spark, sf)
    groups = L.cut(written(L.single_linkage(b, XY, "id"), "k3-merges"), b.select("id"), k=4)
    return K.cluster_profile(b.join(groups, "id"), XY).drop("cluster")


@register("k4_choose_k_planted", f"SELECT count(DISTINCT g) AS k FROM {BLOBS_SQL} AS b")
def k4(spark, sf):
    """The number of clusters with the best silhouette."""
    tried = K.choose_k(blobs(spark, sf), XY, [2, 3, 4, 5, 6], ["id"])
    return tried.agg(F.max_by("k", "silhouette").alias("k"))


@register("k4_gap_statistic_planted", f"SELECT count(DISTINCT g) AS k FROM {BLOBS_SQL} AS b")
def k4_gap(spark, sf):
    return K.gap_statistic(blobs(spark, sf), XY, [1, 2, 3, 4, 5, 6], references=5).where("chosen").select("k")


@register("k5_cluster_scatter_planted", f"SELECT id, x * x / vx + y * y / vy AS norm2 FROM {BLOBS_SQL} AS b, "
          f"(SELECT var_samp(x) AS vx, var_samp(y) AS vy FROM {BLOBS_SQL} AS c)", ["norm2"])
def k5(spark, sf):
    """Two components of two variables turn the plane: lengths stay."""
    b = blobs(spark, sf).withColumn("cluster", F.col("g"))
    return K.cluster_scatter(b, XY, ["id"]).select("id", (F.col("pc1") ** 2 + F.col("pc2") ** 2).alias("norm2"))


def _rule(spark, sf):
    d = doc_labels(spark, sf)
    return d.withColumn("long_text", (F.col("n_chars") >= 1000).cast("double")).withColumn("label", F.col("long_text"))


@register("m1_compare_classifiers_planted", "SELECT unnest(['decision_tree', 'random_forest']) AS model, 1.0::DOUBLE AS accuracy, "
          "1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1, 1.0::DOUBLE AS auc",
          ["accuracy", "precision", "recall", "f1", "auc"])
def m1(spark, sf):
    d, test = _rule(spark, sf), hash_bucket(F.col("doc_id"), 4) == 0
    return M.compare_classifiers(d.where(~test), d.where(test), "label", ["long_text", "n_lines", "digit_share"],
                                 models=["decision_tree", "random_forest"])


@register("m2_compare_regressors_planted", "SELECT unnest(['linear', 'polynomial']) AS model, 1.0::DOUBLE AS r2, 0.0::DOUBLE AS mse, "
          "0.0::DOUBLE AS rmse, 0.0::DOUBLE AS mae", ["r2", "mse", "rmse", "mae"])
def m2(spark, sf):
    li = read_table(spark, sf, "lineitem").withColumn("y", 3 + 2 * F.col("l_quantity") - 5 * F.col("l_discount"))
    test = hash_bucket(F.col("l_orderkey"), 5) == 0
    return M.compare_regressors(li.where(~test), li.where(test), "y", ["l_quantity", "l_discount"], models=["linear", "polynomial"])


@register("m7_feature_importance_planted", "SELECT 'long_text' AS feature")
def m7(spark, sf):
    xs = ["n_lines", "long_text", "digit_share"]
    found = M.feature_importance(M.fit_forest(_rule(spark, sf), "label", xs), xs)
    return found.agg(F.max_by("feature", "importance").alias("feature"))


@register("m7_permutation_importance_planted", "SELECT 'long_text' AS feature, 1.0::DOUBLE AS baseline", ["baseline"])
def m7_permutation(spark, sf):
    d, xs = _rule(spark, sf), ["n_lines", "long_text", "digit_share"]
    model = M.fit_forest(d, "label", xs)
    return M.permutation_importance(model, d, "label", xs, key=["doc_id"]).groupBy("baseline").agg(
        F.max_by("feature", "importance").alias("feature")).select("feature", "baseline")


# two features by the normal equations of the centred sums
def _two(penalty: float) -> str:
    return (f"WITH s AS (SELECT avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my, "
            f"var_pop(l_quantity) * count(*) + {penalty} AS s11, var_pop(l_discount) * count(*) + {penalty} AS s22, "
            "covar_pop(l_quantity, l_discount) * count(*) AS s12, covar_pop(l_quantity, l_extendedprice) * count(*) AS s1y, "
            "covar_pop(l_discount, l_extendedprice) * count(*) AS s2y FROM lineitem), "
            "b AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM s) "
            "SELECT 'intercept' AS term, my - b1 * m1 - b2 * m2 AS coef FROM b UNION ALL SELECT 'l_quantity', b1 FROM b "
            "UNION ALL SELECT 'l_discount', b2 FROM b")


@register("r1_linear_two_features", _two(0.0), ["coef"], digits=6)
def r1(spark, sf):
    return R.linear_regression(read_table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])


@register("r3_ridge_two_features", _two(50.0), ["coef"], digits=6)
def r3(spark, sf):
    return R.ridge(read_table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"], alpha=50.0)


@register("r7_coefficient_table_one_feature", """
WITH s AS (SELECT count(*) AS n, avg(l_quantity) AS mx, var_pop(l_quantity) * count(*) AS sxx, regr_slope(l_extendedprice, l_quantity) AS b,
                  regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem),
e AS (SELECT sum(pow(l_extendedprice - a - b * l_quantity, 2)) / (max(n) - 2) AS v FROM lineitem, s),
t AS (SELECT 'intercept' AS term, a AS coef, sqrt(v * (1.0 / n + mx * mx / sxx)) AS std_error FROM s, e
      UNION ALL SELECT 'l_quantity', b, sqrt(v / sxx) FROM s, e)
SELECT term, coef, std_error, coef / std_error AS t_value FROM t
""", ["coef", "std_error", "t_value"], digits=6)
def r7(spark, sf):
    model, names = R.fit_linear(read_table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"])
    return R.coefficient_table(model, names).drop("p_value")


# AR(2): least squares on two lags, then the recursion
_AR = (f"WITH RECURSIVE m AS ({_M}), g AS (SELECT o_orderdate, y, lag(y, 1) {_W} AS a, lag(y, 2) {_W} AS b FROM m), "
       "s AS (SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS saa, var_pop(b) AS sbb, covar_pop(a, b) AS sab, "
       "covar_pop(a, y) AS say, covar_pop(b, y) AS sby FROM g WHERE b IS NOT NULL), "
       "c AS (SELECT *, (sbb * say - sab * sby) / (saa * sbb - sab * sab) AS p1, (saa * sby - sab * say) / (saa * sbb - sab * sab) AS p2 FROM s), "
       "k AS (SELECT p1, p2, my - p1 * ma - p2 * mb AS p0 FROM c), "
       "l AS (SELECT max(o_orderdate) AS last, arg_max(y, o_orderdate) AS y1, arg_max(a, o_orderdate) AS y2 FROM g), "
       "r AS (SELECT 1 AS step, p0 + p1 * y1 + p2 * y2 AS yhat, y1 AS prev FROM k, l "
       "UNION ALL SELECT step + 1, p0 + p1 * yhat + p2 * prev, yhat FROM r, k WHERE step < 12) "
       "SELECT CAST(step AS BIGINT) AS step, last + to_months(CAST(step AS INTEGER)) AS o_orderdate, yhat, CAST(NULL AS VARCHAR) AS reason FROM r, l")


@register("t9_forecast_ar_closed_form", _AR, ["yhat"], digits=6)
def t9_ar(spark, sf):
    return TS.forecast(monthly_revenue(spark, sf), TS_COL, 12, "ar", "month", p=2)


# Holt's double smoothing from the second step on
_HOLT = (f"WITH RECURSIVE m AS ({_M}), g AS (SELECT row_number() {_W} AS i, o_orderdate, y FROM m), "
         "r AS (SELECT a.i, a.y, CAST(NULL AS DOUBLE) AS fitted, a.y AS level, a.y - b.y AS trend FROM g AS a JOIN g AS b ON a.i = 2 AND b.i = 1 "
         "UNION ALL SELECT g.i, g.y, level + trend, 0.3 * g.y + 0.7 * (level + trend), "
         "0.1 * (0.3 * g.y + 0.7 * (level + trend) - level) + 0.9 * trend FROM r JOIN g ON g.i = r.i + 1), "
         "n AS (SELECT max(i) AS n, max(o_orderdate) AS last FROM g), "
         "e AS (SELECT level, trend FROM r, n WHERE r.i = n.n), "
         "o AS (SELECT 1 - n AS step, y, CAST(NULL AS DOUBLE) AS fitted FROM g, n WHERE i = 1 UNION ALL SELECT i - n, y, fitted FROM r, n "
         f"UNION ALL SELECT h, CAST(NULL AS DOUBLE), level + h * trend FROM e, {_H}) "
         "SELECT CAST(step AS BIGINT) AS step, last + to_months(CAST(step AS INTEGER)) AS o_orderdate, y, fitted, CAST(NULL AS VARCHAR) AS reason FROM o, n")


@register("t8_holt_double", _HOLT, ["y", "fitted"])
def t8(spark, sf):
    return TS.holt_winters(monthly_revenue(spark, sf), TS_COL, 1, 0.3, 0.1, horizon=12, freq="month")
