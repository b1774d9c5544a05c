"""Regression (R1-R8) on Spark ML.

Fits use ``LinearRegression(solver="normal")``: one distributed pass builds
the Gram matrix (treeAggregate), the k x k solve happens on the driver —
bounded by the number of features, not rows.  Results come back as small
coefficient tables; predictions and residuals stay distributed.

Penalty scaling (Spark ML's objective, observed on 4.1):
  ridge  ||y - Xw||^2 + a ||w||^2      -> regParam = a * std_pop(y) / n
  lasso  (1/2n) ||y - Xw||^2 + a |w|_1 -> regParam = a
both with ``standardization=False``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tally.functions.gram import Moments, moments
from tally.functions.stats import as_col, hash_bucket, nan_to_null

def terms_of(k: int, degree: int) -> list[tuple[int, ...]]:
    """The terms of a polynomial of ``k`` variables without the constant: for
    each the variables' numbers, repeated by their power, in order of degree."""
    return [t for d in range(1, degree + 1) for t in combinations_with_replacement(range(k), d)]


def term_name(term: tuple[int, ...], xs: Sequence[str]) -> str:
    powers = Counter(term)
    return "*".join(xs[i] if n == 1 else f"{xs[i]}^{n}" for i, n in sorted(powers.items()))


def design(df: DataFrame, y: str, xs: Sequence[str], degree: int = 1, keep: Sequence[str] = (),
           scaler: Sequence[tuple[float, float]] | None = None) -> tuple[DataFrame, list[str]]:
    """``label`` + ``features`` (optionally polynomial) for rows where y and
    every x are present (NULL and NaN are missing; VectorAssembler rejects
    them, so such rows are skipped).  ``scaler`` gives (centre, scale) per x
    for the polynomial's variables."""
    xs = list(xs)
    keep = [k for k in keep if k not in xs]
    base = df.select(*[as_col(k) for k in keep], nan_to_null(y).alias("label"),
                     *[nan_to_null(x).alias(x) for x in xs]).na.drop(subset=["label", *[f"`{x}`" for x in xs]])
    z = [as_col(x) if scaler is None else (as_col(x) - F.lit(scaler[i][0])) / F.lit(scaler[i][1])
         for i, x in enumerate(xs)]
    terms = terms_of(len(xs), degree)
    products = []
    for t in terms:
        c = z[t[0]]
        for i in t[1:]:
            c = c * z[i]
        products.append(c)
    wide = base.select("*", *[c.alias(f"_t{i}") for i, c in enumerate(products)])
    cols = [f"_t{i}" for i in range(len(terms))]
    out = VectorAssembler(inputCols=cols, outputCol="features").transform(wide).drop(*cols)
    return out, [term_name(t, xs) for t in terms]


def _scaler(df: DataFrame, y: str, xs: Sequence[str]) -> list[tuple[float, float]]:
    """Centre and scale of every x over the rows of the fit (one aggregate)."""
    data, _ = design(df, y, xs)
    row = data.agg(*[f(as_col(x)).alias(f"_{k}{i}") for i, x in enumerate(xs)
                     for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return [(float(row[f"_m{i}"] or 0.0), float(row[f"_s{i}"] or 0.0) or 1.0) for i in range(len(xs))]


def _unscale(intercept: float, coefs: Sequence[float], k: int, degree: int,
             scaler: Sequence[tuple[float, float]]) -> tuple[float, list[float]]:
    """Coefficients in the terms of x from those in (x - centre) / scale."""
    terms = terms_of(k, degree)
    out: dict[tuple[int, ...], float] = {(): float(intercept)}
    for t, c in zip(terms, coefs):
        product = {(): float(c)}  # expand the term, one factor (x_i - m) / s at a time
        for i in t:
            m, s = scaler[i]
            grown: dict[tuple[int, ...], float] = {}
            for u, v in product.items():
                grown[tuple(sorted((*u, i)))] = grown.get(tuple(sorted((*u, i))), 0.0) + v / s
                grown[u] = grown.get(u, 0.0) - v * m / s
            product = grown
        for u, v in product.items():
            out[u] = out.get(u, 0.0) + v
    return out[()], [out.get(t, 0.0) for t in terms]


def fit_linear(df: DataFrame, y: str, xs: Sequence[str], degree: int = 1, reg: float = 0.0,
               l1_ratio: float = 0.0, solver: str = "normal", fit_intercept: bool = True,
               max_iter: int = 500, tol: float = 1e-12) -> tuple[LinearRegressionModel, list[str]]:
    """A fitted model and the names of its terms.  An unpenalised polynomial
    is fitted in centred and scaled variables, which keeps the powers of a
    large x apart; the model carries the scaling (``predict`` applies it) and
    ``coefficients`` are given in the terms of x."""
    scaler = _scaler(df, y, xs) if degree > 1 and not reg and fit_intercept else None
    data, names = design(df, y, xs, degree, scaler=scaler)
    lr = LinearRegression(featuresCol="features", labelCol="label", regParam=reg, elasticNetParam=l1_ratio,
                          standardization=False, solver=solver, fitIntercept=fit_intercept,
                          maxIter=max_iter, tol=tol)
    model = lr.fit(data)
    model.spark_session, model.scaler, model.shape = df.sparkSession, scaler, (len(xs), degree)
    return model, names


def _session(model: LinearRegressionModel) -> SparkSession:
    return getattr(model, "spark_session", None) or SparkSession.getActiveSession()


def coefficients(model: LinearRegressionModel, names: Sequence[str]) -> DataFrame:
    """``(term, coef)``; the intercept first."""
    intercept, coefs = float(model.intercept), [float(c) for c in model.coefficients]
    if getattr(model, "scaler", None):
        intercept, coefs = _unscale(intercept, coefs, *model.shape, model.scaler)
    rows = [("intercept", intercept), *zip(names, coefs, strict=True)]
    return _session(model).createDataFrame(rows, "term string, coef double")


# ------------------------------------------------------------------ R1-R4
def linear_regression(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """R1 — ordinary least squares; coefficient table."""
    return coefficients(*fit_linear(df, y, xs))


def polynomial_regression(df: DataFrame, y: str, xs: Sequence[str], degree: int = 2) -> DataFrame:
    """R2 — least squares on the polynomial expansion of ``xs``."""
    return coefficients(*fit_linear(df, y, xs, degree=degree))


def _n_and_std(df: DataFrame, y: str, xs: Sequence[str]) -> tuple[int, float]:
    ok = df.select(nan_to_null(y).alias("_y"), *[nan_to_null(x).alias(f"_x{i}") for i, x in enumerate(xs)]).na.drop()
    r = ok.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("_y").alias("s")).first()
    return int(r["n"]), float(r["s"] or 0.0)


def ridge(df: DataFrame, y: str, xs: Sequence[str], alpha: float, degree: int = 1) -> DataFrame:
    """R3 — minimises ||y - Xw||^2 + alpha ||w||^2 (intercept unpenalised)."""
    n, sy = _n_and_std(df, y, xs)
    reg = alpha * sy / n if n and sy else 0.0
    return coefficients(*fit_linear(df, y, xs, degree=degree, reg=reg, l1_ratio=0.0))


def lasso(df: DataFrame, y: str, xs: Sequence[str], alpha: float, degree: int = 1) -> DataFrame:
    """R4 — minimises (1/2n) ||y - Xw||^2 + alpha |w|_1 (intercept unpenalised)."""
    return coefficients(*fit_linear(df, y, xs, degree=degree, reg=alpha, l1_ratio=1.0))


# ------------------------------------------------------------------ R5 R6
def predict(model: LinearRegressionModel, df: DataFrame, y: str, xs: Sequence[str], degree: int = 1,
            keep: Sequence[str] = ()) -> DataFrame:
    """``keep..., y, yhat`` for every row with y and xs present."""
    data, _ = design(df, y, xs, degree, keep, getattr(model, "scaler", None))
    return model.transform(data).select(*keep, F.col("label").alias("y"), F.col("prediction").alias("yhat"))


def regression_metrics(pred: DataFrame, y: str = "y", yhat: str = "yhat", by: Sequence[str] = ()) -> DataFrame:
    """n, R^2, MSE, RMSE, MAE in one aggregate (per ``by`` group)."""
    e = F.col(y) - F.col(yhat)
    one = pred.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
                   F.sum(e * e).alias("_sse"), (F.var_pop(y) * F.count(y)).alias("_sst"))
    return one.select(*by, "n", (1 - F.col("_sse") / F.when(F.col("_sst") != 0, F.col("_sst"))).alias("r2"),
                      "mse", F.sqrt("mse").alias("rmse"), "mae")


def residuals(pred: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    return pred.withColumn("resid", F.col(y) - F.col(yhat))


def residual_summary(pred: DataFrame, y: str = "y", yhat: str = "yhat", ts: str | None = None,
                     by: Sequence[str] = ()) -> DataFrame:
    """Mean, std, skewness of the residuals; with ``ts`` also Durbin-Watson
    sum (e_t - e_(t-1))^2 / sum e_t^2 along time, per ``by`` series (run it on
    a time grid, see timeseries.resample: the window is per series)."""
    by = list(by)
    r = pred.select(*by, *([ts] if ts else []), (F.col(y) - F.col(yhat)).alias("e"))
    aggs = [F.count("e").alias("n"), F.avg("e").alias("mean"), F.stddev_samp("e").alias("std"),
            F.skewness("e").alias("skewness")]
    if ts:
        d = F.col("e") - F.lag("e", 1).over(Window.partitionBy(*by).orderBy(ts))
        r = r.withColumn("_d2", d * d)
        aggs.append((F.sum("_d2") / F.sum(F.col("e") * F.col("e"))).alias("durbin_watson"))
    return r.groupBy(*by).agg(*aggs)


def influence(df: DataFrame, y: str, xs: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``keep..., y, yhat, resid, leverage, student, cooks_distance`` of an ordinary least-squares fit.

    The leverage is the hat matrix' diagonal 1/n + (x - m)' S^-1 (x - m), where S (features x
    features, on the driver) is the only thing gathered; ``student`` is the internally studentised
    residual and Cook's distance student^2 / (k + 1) * h / (1 - h).  Rows with a missing value are left
    out.  NULL where a row has leverage 1 or the fit leaves no degree of freedom."""
    k, names = len(xs), [f"_x{i}" for i in range(len(xs))]
    kept = [f"_k{i}" for i in range(len(keep))]
    rows = df.select(*[as_col(c).alias(n) for c, n in zip(keep, kept)], nan_to_null(y).alias("_y"),
                     *[nan_to_null(x).alias(n) for x, n in zip(xs, names)]).na.drop(subset=["_y", *names])
    m = moments(rows, [F.col("_y"), *[F.col(n) for n in names]])
    s = Moments(m.n, m.means[1:], m.products[1:, 1:])
    inverse = s.inverse()
    slopes = inverse @ m.products[1:, 0]
    sse = float(m.products[0, 0] - slopes @ m.products[1:, 0])
    free = m.n - k - 1
    yhat = F.lit(float(m.means[0]))
    for n, mean, b in zip(names, s.means, slopes):
        yhat = yhat + F.lit(float(b)) * (F.col(n) - F.lit(float(mean)))
    out = rows.select(*kept, F.col("_y").alias("y"), yhat.alias("yhat"), (F.col("_y") - yhat).alias("resid"),
                      (F.lit(1.0 / max(m.n, 1)) + s.form([F.col(n) for n in names], inverse)).alias("leverage"))
    open_ = 1 - F.col("leverage")
    variance = F.lit(max(sse, 0.0) / free if free > 0 else None).cast("double")
    student = F.col("resid") / F.sqrt(F.when((variance > 0) & (open_ > 1e-12), variance * open_))
    out = out.withColumn("student", student).withColumn(
        "cooks_distance", F.col("student") ** 2 / (k + 1) * F.col("leverage") / F.when(open_ > 1e-12, open_))
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, kept)], "y", "yhat", "resid", "leverage", "student", "cooks_distance")


def variance_inflation(df: DataFrame, xs: Sequence[str]) -> DataFrame:
    """``(term, vif)``: the diagonal of the inverse correlation matrix, over rows that have every feature;
    NULL for a feature that is constant or that the others determine."""
    rows = df.select(*[nan_to_null(x).alias(f"_x{i}") for i, x in enumerate(xs)]).na.drop()
    m = moments(rows, [F.col(f"_x{i}") for i in range(len(xs))])
    d = np.diag(m.products)
    scale = np.where(d > 0, np.sqrt(d), 1.0)
    corr = m.products / np.outer(scale, scale)
    out = []
    for i, x in enumerate(xs):
        rest = [j for j in range(len(xs)) if j != i]
        coef = np.linalg.lstsq(corr[np.ix_(rest, rest)], corr[rest, i], rcond=1e-12)[0]
        left = 1.0 - float(coef @ corr[rest, i])
        out.append((x, 1.0 / left if d[i] > 0 and left > 1e-10 else None))
    return df.sparkSession.createDataFrame(out, "term string, vif double")


# --------------------------------------------------------------------- R7
def coefficient_table(model: LinearRegressionModel, names: Sequence[str]) -> DataFrame:
    """Coefficient, standard error, t and p values (normal solver without an
    L1 term; Spark reports the intercept's statistics last)."""
    s = model.summary
    se, tv, pv = s.coefficientStandardErrors, s.tValues, s.pValues
    k = len(names)
    rows = [(n, float(model.coefficients[i]), float(se[i]), float(tv[i]), float(pv[i])) for i, n in enumerate(names)]
    if len(se) > k:
        rows.insert(0, ("intercept", float(model.intercept), float(se[k]), float(tv[k]), float(pv[k])))
    return _session(model).createDataFrame(rows, "term string, coef double, std_error double, t_value double, p_value double")


# --------------------------------------------------------------------- R8
def split(df: DataFrame, key: str, test_mod: int = 5, test_bucket: int = 0) -> DataFrame:
    """Repeatable train/test split: ``is_test`` = bucket of the hashed key
    (``functions.stats.hash_bucket``).  Unlike randomSplit it does not depend
    on partitioning, nor on how the keys are numbered."""
    return df.withColumn("is_test", hash_bucket(as_col(key), test_mod) == test_bucket)
