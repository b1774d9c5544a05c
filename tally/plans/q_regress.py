"""Registered queries R1-R8 (regression).

Model outputs are compared at 7 significant digits (Spark's normal-equation
solver and SQL's closed forms agree to about 1e-10 relative); residual rows
at 6.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tally.functions.stats import hash_bucket_sql
from tally.operators import regress as R
from tally.operators import timeseries as TS
from tally.plans.catalog import register
from tally.plans.q_timeseries import TS_COL, monthly_revenue
from tally.sources.files import read_table


def part_target(spark, sf):
    """part with a real signal: target = p_retailprice + 3 p_size."""
    p = read_table(spark, sf, "part")
    return p.withColumn("target", F.col("p_retailprice") + 3.0 * F.col("p_size"))


_PART = "(SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice + 3.0 * p_size AS y FROM part)"


# --------------------------------------------------------------------- R1
@register("r1_linear_regression", "SELECT 'intercept' AS term, regr_intercept(l_extendedprice, l_quantity) AS coef "
                                  "FROM lineitem UNION ALL SELECT 'l_quantity', regr_slope(l_extendedprice, l_quantity) "
                                  "FROM lineitem", ["coef"], digits=7)
def r1(spark, sf):
    return R.linear_regression(read_table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"])


@register("r1_linear_regression_multi")
def r1_multi(spark, sf):
    return R.linear_regression(read_table(spark, sf, "lineitem"), "l_extendedprice",
                               ["l_quantity", "l_discount", "l_tax"])


# --------------------------------------------------------------------- R2
_R2_SQL = f"""
WITH d AS (SELECT x AS x1, x * x AS x2, y FROM {_PART} AS p),
s AS (SELECT var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12, covar_pop(x1, y) AS s1y,
             covar_pop(x2, y) AS s2y, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my FROM d),
b AS (SELECT (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
             (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2, m1, m2, my FROM s)
SELECT 'intercept' AS term, my - b1 * m1 - b2 * m2 AS coef FROM b
UNION ALL SELECT 'p_size', b1 FROM b UNION ALL SELECT 'p_size^2', b2 FROM b
"""


@register("r2_polynomial_regression", _R2_SQL, ["coef"], digits=7)
def r2(spark, sf):
    return R.polynomial_regression(part_target(spark, sf), "target", ["p_size"], degree=2)


# ------------------------------------------------------------------ R3 R4
_R3_SQL = (f"WITH s AS (SELECT covar_pop(x, y) / (var_pop(x) + 1000.0 / count(*)) AS b, avg(x) AS mx, avg(y) AS my "
           f"FROM {_PART} AS p) SELECT 'intercept' AS term, my - b * mx AS coef FROM s "
           "UNION ALL SELECT 'p_size', b FROM s")


@register("r3_ridge", _R3_SQL, ["coef"], digits=7)
def r3(spark, sf):
    return R.ridge(part_target(spark, sf), "target", ["p_size"], alpha=1000.0)


_R4_SQL = (f"WITH s AS (SELECT sign(covar_pop(x, y)) * greatest(abs(covar_pop(x, y)) - 100.0, 0) / var_pop(x) AS b, "
           f"avg(x) AS mx, avg(y) AS my FROM {_PART} AS p) SELECT 'intercept' AS term, my - b * mx AS coef FROM s "
           "UNION ALL SELECT 'p_size', b FROM s")


@register("r4_lasso", _R4_SQL, ["coef"], digits=7)
def r4(spark, sf):
    return R.lasso(part_target(spark, sf), "target", ["p_size"], alpha=100.0)


@register("r3_ridge_multi")
def r3_multi(spark, sf):
    return R.ridge(read_table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], 1000.0)


@register("r4_lasso_multi")
def r4_multi(spark, sf):
    return R.lasso(read_table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], 5.0)


# ------------------------------------------------------------------ R5 R6
def _ols_predictions(spark, sf):
    li = read_table(spark, sf, "lineitem")
    model, _ = R.fit_linear(li, "l_extendedprice", ["l_quantity"])
    return R.predict(model, li, "l_extendedprice", ["l_quantity"], keep=["l_orderkey", "l_linenumber"])


_PRED = ("WITH c AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) "
         "AS a FROM lineitem), p AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS y, a + b * l_quantity AS yhat "
         "FROM lineitem, c) ")


@register("r5_regression_metrics", _PRED + "SELECT count(*) AS n, 1 - sum((y - yhat) * (y - yhat)) / "
                                           "(var_pop(y) * count(y)) AS r2, avg((y - yhat) * (y - yhat)) AS mse, "
                                           "sqrt(avg((y - yhat) * (y - yhat))) AS rmse, avg(abs(y - yhat)) AS mae FROM p",
          ["r2", "mse", "rmse", "mae"], digits=7)
def r5(spark, sf):
    return R.regression_metrics(_ols_predictions(spark, sf))


@register("r6_residuals", _PRED + "SELECT l_orderkey, l_linenumber, y, yhat, y - yhat AS resid FROM p",
          ["y", "yhat", "resid"], digits=6)
def r6(spark, sf):
    return R.residuals(_ols_predictions(spark, sf))


_R6S_SQL = (f"WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS o_orderdate, "
            "sum(o_totalprice) AS y FROM orders GROUP BY 1), "
            "g AS (SELECT o_orderdate, y, CAST(row_number() OVER (ORDER BY o_orderdate) - 1 AS DOUBLE) AS idx FROM m), "
            "c AS (SELECT regr_slope(y, idx) AS b, regr_intercept(y, idx) AS a FROM g), "
            "e AS (SELECT o_orderdate, y - (a + b * idx) AS e FROM g, c), "
            "d AS (SELECT e, e - lag(e) OVER (ORDER BY o_orderdate) AS d FROM e), "
            "mo AS (SELECT avg(e) AS mu FROM e), "
            "mm AS (SELECT avg(pow(e - mu, 2)) AS m2, avg(pow(e - mu, 3)) AS m3 FROM e, mo) "
            "SELECT count(e) AS n, round(avg(e), 3) AS mean, stddev_samp(e) AS std, "
            "(SELECT m3 / pow(m2, 1.5) FROM mm) AS skewness, sum(d * d) / sum(e * e) AS durbin_watson FROM d")


_INFLUENCE = """
WITH s AS (SELECT count(*) AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my, var_pop(l_quantity) * count(*) AS sxx,
                  regr_slope(l_extendedprice, l_quantity) AS b FROM lineitem),
p AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS y, my + b * (l_quantity - mx) AS yhat,
             1.0 / n + (l_quantity - mx) * (l_quantity - mx) / sxx AS leverage, n FROM lineitem, s),
v AS (SELECT sum((y - yhat) * (y - yhat)) / (max(n) - 2) AS v FROM p),
t AS (SELECT l_orderkey, l_linenumber, y, yhat, y - yhat AS resid, leverage, (y - yhat) / sqrt(v * (1 - leverage)) AS student FROM p, v)
SELECT *, student * student / 2 * leverage / (1 - leverage) AS cooks_distance FROM t
"""


@register("r6_influence", _INFLUENCE, ["y", "yhat", "resid", "leverage", "student", "cooks_distance"], digits=6)
def r6_influence(spark, sf):
    return R.influence(read_table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"], keep=["l_orderkey", "l_linenumber"])


@register("r6_variance_inflation", "SELECT unnest(['l_quantity', 'l_tax']) AS term, 1 / (1 - pow(corr(l_quantity, l_tax), 2)) AS vif FROM lineitem",
          ["vif"])
def r6_vif(spark, sf):
    return R.variance_inflation(read_table(spark, sf, "lineitem"), ["l_quantity", "l_tax"])


@register("r6_residual_summary", _R6S_SQL, ["mean", "std", "skewness", "durbin_watson"], digits=6)
def r6_summary(spark, sf):
    grid = TS.with_index(monthly_revenue(spark, sf), TS_COL, "month")
    model, _ = R.fit_linear(grid, "y", ["idx"])
    pred = R.predict(model, grid, "y", ["idx"], keep=[TS_COL])
    s = R.residual_summary(pred, ts=TS_COL)
    # the OLS residual mean is zero up to rounding noise of either engine
    return s.withColumn("mean", F.round("mean", 3))


# --------------------------------------------------------------------- R7
@register("r7_coefficient_table")
def r7(spark, sf):
    li = read_table(spark, sf, "lineitem")
    model, names = R.fit_linear(li, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    return R.coefficient_table(model, names)


# --------------------------------------------------------------------- R8
@register("r8_split", f"SELECT l_orderkey, l_linenumber, {hash_bucket_sql('l_orderkey', 5)} = 0 AS is_test FROM lineitem")
def r8(spark, sf):
    return R.split(read_table(spark, sf, "lineitem"), "l_orderkey").select("l_orderkey", "l_linenumber", "is_test")
