"""Influence, variance inflation and joint outliers against numpy."""

import numpy as np
import pytest

from tally.operators import clean as K
from tally.operators import regress as R


def frame(spark, x, y=None):
    cols = [f"x{i}" for i in range(x.shape[1])] + (["y"] if y is not None else [])
    data = np.column_stack([x, y]) if y is not None else x
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(data)], "n long, " + ", ".join(f"{c} double" for c in cols))


def test_influence_of_several_features(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (300, 3)) * [1, 1000, 0.01] + [5, 1e6, 0]
    y = x @ [2, 0.01, 30] + rng.normal(0, 1, 300)
    x[7], y[9] = [40, 1e6, 1.0], y[9] + 60
    q, _ = np.linalg.qr(np.column_stack([np.ones(300), (x - x.mean(0)) / x.std(0)]))
    h = (q ** 2).sum(1)
    e = y - q @ (q.T @ y)
    s2 = (e ** 2).sum() / (300 - 4)
    student = e / np.sqrt(s2 * (1 - h))
    got = sorted(R.influence(frame(spark, x, y).withColumnRenamed("n", "y_"), "y", ["x0", "x1", "x2"], keep=["y_"]).collect())
    assert np.allclose([r["leverage"] for r in got], h, rtol=1e-7)
    assert np.allclose([r["resid"] for r in got], e, atol=1e-6)
    assert np.allclose([r["student"] for r in got], student, rtol=1e-6, atol=1e-8)
    assert np.allclose([r["cooks_distance"] for r in got], student ** 2 / 4 * h / (1 - h), rtol=1e-6, atol=1e-12)
    assert max(got, key=lambda r: r["leverage"])["y_"] == 7 and sum(r["leverage"] for r in got) == pytest.approx(4)


def test_influence_of_few_or_missing_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (None, 1.0), (3.0, float("nan"))], "x double, y double")
    rows = R.influence(df, "y", ["x"]).collect()
    assert len(rows) == 2 and all(r["student"] is None and r["leverage"] == pytest.approx(1.0) for r in rows)
    assert R.influence(df.limit(0), "y", ["x"]).collect() == []


def test_variance_inflation(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (400, 3))
    x[:, 2] = x[:, 0] + 0.3 * rng.normal(0, 1, 400)
    want = np.diag(np.linalg.inv(np.corrcoef(x.T)))
    got = {r["term"]: r["vif"] for r in R.variance_inflation(frame(spark, x), ["x0", "x1", "x2"]).collect()}
    assert np.allclose([got[f"x{i}"] for i in range(3)], want)
    twin = frame(spark, np.column_stack([x[:, 0], 2 * x[:, 0], np.ones(400)]))
    assert [r["vif"] for r in R.variance_inflation(twin, ["x0", "x1", "x2"]).collect()] == [None, None, None]


def test_joint_outliers_that_no_single_column_shows(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(0, 1, 1000)
    x = np.column_stack([a, a + 0.05 * rng.normal(0, 1, 1000), rng.normal(10, 3, 1000)])
    x[[3, 500]] = [[1.5, -1.5, 10], [-1.0, 1.0, 12]]
    z = x - x.mean(0)
    want = (z @ np.linalg.inv(np.cov(x.T)) * z).sum(1)
    out = sorted(K.flag_outliers_joint(frame(spark, x), ["x0", "x1", "x2"], p=0.9999).collect())
    assert np.allclose([r["mahalanobis2"] for r in out], want, rtol=1e-8)
    assert {r["n"] for r in out if r["is_outlier"]} == {3, 500}
    assert not any(r["is_outlier"] for r in K.flag_outliers(frame(spark, x), "x0", "zscore").where("n in (3, 500)").collect())
    twice = K.flag_outliers_joint(frame(spark, x).selectExpr("*", "x0 * 2 as again"), ["x0", "x1", "x2", "again"], limit=20.0)
    assert np.allclose([r["mahalanobis2"] for r in sorted(twice.collect())], want, rtol=1e-6)
    missing = spark.createDataFrame([(1.0, None), (float("nan"), 2.0), (1.0, 2.0)], "x0 double, x1 double")
    assert [r["is_outlier"] for r in K.flag_outliers_joint(missing, ["x0", "x1"]).collect()] == [False] * 3
    assert K.flag_outliers_joint(missing.limit(0), ["x0", "x1"]).collect() == []


@pytest.mark.parametrize("p,k,want", [(0.95, 2, 5.991), (0.999, 3, 16.266), (0.99, 10, 23.209)])
def test_chi_square_quantiles(p, k, want):
    assert K.chi2_quantile(p, k) == pytest.approx(want, rel=1e-4)
