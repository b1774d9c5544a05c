"""Invariants and brute-force references for operators that plain SQL cannot
check (model fits, clustering, recursions), plus the shared helpers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_TINY
from tally.functions.stats import running_sums
from tally.operators import cluster as K
from tally.operators import evaluate as M
from tally.operators import regress as R
from tally.operators import timeseries as TS
from tally.sources.files import read_table, sample_table


def _pdf(df):
    return pd.DataFrame([r.asDict() for r in df.collect()])


# ------------------------------------------------------------ helpers
@pytest.mark.parametrize("buckets", [1, 3, 8])
def test_running_sums_match_cumsum(spark, buckets):
    ev = read_table(spark, SF_TINY, "events").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    got = _pdf(running_sums(ev, "value", ["n"], buckets=buckets)).sort_values("value")
    assert np.array_equal(got["cum_n"].to_numpy(), got["n"].cumsum().to_numpy())
    desc = _pdf(running_sums(ev, "value", ["n"], descending=True, buckets=buckets)).sort_values(
        "value", ascending=False)
    assert np.array_equal(desc["cum_n"].to_numpy(), desc["n"].cumsum().to_numpy())


def test_sample_table_is_repeatable(spark):
    a = sample_table(spark, 500, seed=3, partitions=1)
    b = sample_table(spark, 500, seed=3, partitions=7)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert a.count() == 500


# ------------------------------------------------------------ regression
def test_ols_matches_numpy_lstsq(spark):
    li = read_table(spark, SF_TINY, "lineitem")
    xs = ["l_quantity", "l_discount", "l_tax"]
    coef = {r["term"]: r["coef"] for r in R.linear_regression(li, "l_extendedprice", xs).collect()}
    p = _pdf(li.select("l_extendedprice", *xs))
    X = np.column_stack([np.ones(len(p))] + [p[x].to_numpy() for x in xs])
    ref, *_ = np.linalg.lstsq(X, p["l_extendedprice"].to_numpy(), rcond=None)
    got = np.array([coef["intercept"]] + [coef[x] for x in xs])
    assert np.allclose(got, ref, rtol=1e-7, atol=1e-6)


def test_ols_residuals_orthogonal(spark):
    li = read_table(spark, SF_TINY, "lineitem")
    model, _ = R.fit_linear(li, "l_extendedprice", ["l_quantity", "l_tax"])
    pred = R.residuals(R.predict(model, li, "l_extendedprice", ["l_quantity", "l_tax"],
                                 keep=["l_quantity", "l_tax"]))
    r = pred.agg(F.sum("resid").alias("s0"), F.sum(F.col("resid") * F.col("l_quantity")).alias("s1"),
                 F.sum(F.col("resid") * F.col("l_tax")).alias("s2"), F.sum(F.abs("resid")).alias("a")).first()
    assert abs(r["s0"]) < 1e-6 * r["a"] and abs(r["s1"]) < 1e-6 * r["a"] * 50 and abs(r["s2"]) < 1e-6 * r["a"]


def test_ridge_norm_falls_with_alpha(spark):
    part = read_table(spark, SF_TINY, "part").withColumn("target", F.col("p_retailprice") + 3.0 * F.col("p_size"))
    norms = []
    for a in (0.0, 100.0, 10_000.0, 1_000_000.0):
        c = {r["term"]: r["coef"] for r in R.ridge(part, "target", ["p_size", "p_retailprice"], a).collect()}
        norms.append(c["p_size"] ** 2 + c["p_retailprice"] ** 2)
    assert all(x >= y - 1e-9 for x, y in zip(norms, norms[1:]))


def test_ridge_matches_closed_form_two_features(spark):
    part = read_table(spark, SF_TINY, "part").withColumn("target", F.col("p_retailprice") + 3.0 * F.col("p_size"))
    xs, alpha = ["p_size", "p_retailprice"], 500.0
    c = {r["term"]: r["coef"] for r in R.ridge(part, "target", xs, alpha).collect()}
    p = _pdf(part.select("target", *xs))
    X = p[xs].to_numpy() - p[xs].to_numpy().mean(0)
    y = p["target"].to_numpy() - p["target"].mean()
    ref = np.linalg.solve(X.T @ X + alpha * np.eye(2), X.T @ y)
    assert np.allclose([c[x] for x in xs], ref, rtol=1e-6)


def test_lasso_reaches_zero(spark):
    part = read_table(spark, SF_TINY, "part").withColumn("target", F.col("p_retailprice") + 3.0 * F.col("p_size"))
    sxy = part.agg(F.covar_pop("p_size", "target")).first()[0]
    c = {r["term"]: r["coef"] for r in R.lasso(part, "target", ["p_size"], abs(sxy) + 1.0).collect()}
    assert abs(c["p_size"]) < 1e-9
    c2 = {r["term"]: r["coef"] for r in R.lasso(part, "target", ["p_size"], abs(sxy) / 2).collect()}
    assert c2["p_size"] > 0


def test_polynomial_term_names(spark):
    names = lambda xs, d: [R.term_name(t, xs) for t in R.terms_of(len(xs), d)]
    assert names(["a", "b"], 2) == ["a", "b", "a^2", "a*b", "b^2"]
    assert len(names([f"x{i}" for i in range(20)], 2)) == 20 + 20 * 21 // 2


def test_coefficient_table_t_values(spark):
    li = read_table(spark, SF_TINY, "lineitem")
    model, names = R.fit_linear(li, "l_extendedprice", ["l_quantity", "l_discount"])
    for r in R.coefficient_table(model, names).collect():
        assert r["std_error"] > 0
        assert r["t_value"] == pytest.approx(r["coef"] / r["std_error"], rel=1e-9)
        assert 0.0 <= r["p_value"] <= 1.0


# ------------------------------------------------------------ evaluation
def _doc_pred(spark):
    from tally.plans.fixtures import doc_labels
    d = doc_labels(spark, SF_TINY)
    return d.select(F.col("quality").cast("double").alias("label"), F.col("n_chars").alias("score"))


def test_roc_monotone_and_auc_brute_force(spark):
    pred = _doc_pred(spark)
    roc = _pdf(M.roc_curve(pred, "label", "score"))
    roc = roc.sort_values(["fpr", "tpr"])
    assert roc["tpr"].is_monotonic_increasing and roc["fpr"].is_monotonic_increasing
    assert roc["tpr"].iloc[-1] == pytest.approx(1.0) and roc["fpr"].iloc[-1] == pytest.approx(1.0)
    p = _pdf(pred)
    pos, neg = p[p.label == 1].score.to_numpy(), p[p.label != 1].score.to_numpy()
    ref = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    got = M.auc(pred, "label", "score").first()["auc"]
    assert got == pytest.approx(ref, rel=1e-12)
    trap = np.trapezoid(roc["tpr"], roc["fpr"])
    assert trap == pytest.approx(ref, rel=1e-9)


def test_feature_importances_sum_to_one(spark):
    from tally.plans.fixtures import doc_labels
    xs = ["n_chars", "n_lines", "n_words", "digit_share"]
    imp = _pdf(M.feature_importance(M.fit_forest(doc_labels(spark, SF_TINY), "quality", xs), xs))
    assert imp["importance"].sum() == pytest.approx(1.0)
    assert (imp["importance"] >= 0).all()


def test_compare_classifiers_bounds(spark):
    from tally.plans.fixtures import doc_labels
    d = doc_labels(spark, SF_TINY)
    test = F.pmod(F.col("doc_id"), F.lit(5)) == 0
    out = _pdf(M.compare_classifiers(d.where(~test), d.where(test), "quality", ["n_chars", "n_words"],
                                     models=["logistic", "decision_tree", "naive_bayes"]))
    assert len(out) == 3
    for c in ("accuracy", "auc"):
        assert out[c].between(0, 1).all()


def test_confusion_matrix_has_zero_cells(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 0.0), (1.0, 0.0)], "label double, prediction double")
    cm = {(r["label"], r["prediction"]): r["count"] for r in M.confusion_matrix(df).collect()}
    assert cm == {(0.0, 0.0): 2, (0.0, 1.0): 0, (1.0, 0.0): 1, (1.0, 1.0): 0}


# ------------------------------------------------------------ clustering
def _blobs(spark):
    """Four well separated groups, by rule on id (FIXTURES.md blobs)."""
    return spark.range(1000).select(
        F.col("id"), (F.col("id") % 4).alias("centre"),
        (10.0 * (F.col("id") % 2) + (F.col("id") % 17) / 17.0).alias("x"),
        (10.0 * (F.floor(F.col("id") / 2) % 2) + (F.col("id") % 19) / 19.0).alias("y"))


def _purity(pdf):
    return pdf.groupby("cluster")["centre"].nunique().max() == 1 and pdf["cluster"].nunique() == 4


@pytest.mark.parametrize("fn", ["kmeans", "hierarchical", "agglomerative"])
def test_clusterers_recover_blobs(spark, fn):
    b = _blobs(spark)
    if fn == "agglomerative":
        out = K.agglomerative(b, ["x", "y"], 4, key=["id", "centre"], micro=20)
    else:
        out = getattr(K, fn)(b, ["x", "y"], 4, key=["id", "centre"])
    assert _purity(_pdf(out.select("cluster", "centre")))


def test_kmeans_rows_nearest_to_own_centre(spark):
    from tally.plans.fixtures import customer_rfm
    rfm = customer_rfm(spark, SF_TINY)
    xs = ["frequency", "monetary", "recency"]
    out = _pdf(K.kmeans(rfm, xs, 3, key=["custkey"]))
    z = (out[xs] - out[xs].mean()) / out[xs].std(ddof=1)
    cent = z.groupby(out["cluster"]).mean()
    d = ((z.to_numpy()[:, None, :] - cent.to_numpy()[None, :, :]) ** 2).sum(-1)
    nearest = cent.index.to_numpy()[d.argmin(1)]
    assert (nearest == out["cluster"].to_numpy()).mean() > 0.99


def test_choose_k_inertia_falls(spark):
    out = _pdf(K.choose_k(_blobs(spark), ["x", "y"], [2, 3, 4, 6])).sort_values("k")
    inertia = out["inertia"].to_numpy()
    assert all(a >= b * 0.95 for a, b in zip(inertia, inertia[1:]))
    assert out["silhouette"].between(-1, 1).all()
    assert out.loc[out.k == 4, "silhouette"].iloc[0] > 0.5


def test_ward_merges_small():
    cent = np.array([[0.0], [0.1], [10.0], [10.2]])
    groups, merges = K.ward_merges(cent, np.array([1, 1, 1, 1]), 2)
    assert groups[0] == groups[1] and groups[2] == groups[3] and groups[0] != groups[2]
    assert len(merges) == 2


def test_cluster_scatter_has_two_components(spark):
    out = K.cluster_scatter(K.kmeans(_blobs(spark), ["x", "y"], 4, key=["id"]), ["x", "y"], key=["id"])
    assert out.columns == ["id", "cluster", "pc1", "pc2"] and out.count() == 1000


# ------------------------------------------------------------ time series
def _seasonal(spark):
    """y = 100 + 2t + 10 (t mod 12), monthly from 2000-01 (FIXTURES.md)."""
    return spark.range(120).select(
        F.add_months(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).cast("timestamp_ntz").alias("ts"),
        (100.0 + 2.0 * F.col("id") + 10.0 * (F.col("id") % 12)).alias("y"))


def test_decompose_exact_on_seasonal(spark):
    d = _pdf(TS.decompose(_seasonal(spark), "ts", "month", 12)).sort_values("ts").reset_index(drop=True)
    full = d.dropna()
    t = full.index.to_numpy()
    assert np.allclose(full["trend"], 100 + 2 * t + 55)
    assert np.allclose(full["seasonal"], 10 * (t % 12) - 55)
    assert np.allclose(full["resid"], 0, atol=1e-9)
    assert np.allclose(full["y"], full["trend"] + full["seasonal"] + full["resid"])
    assert d["trend"].isna().sum() == 12


def test_ewm_matches_pandas(spark):
    s = _seasonal(spark)
    got = _pdf(TS.ewm(s, "ts", "month", 0.3)).sort_values("ts")
    ref = got["y"].ewm(alpha=0.3, adjust=False).mean()
    assert np.allclose(got["ewm"], ref, rtol=1e-12)


def test_ewm_per_series(spark):
    s = _seasonal(spark)
    two = s.withColumn("k", F.lit("a")).unionByName(s.withColumn("k", F.lit("b")).withColumn("y", F.col("y") * 2))
    got = _pdf(TS.ewm(two, "ts", "month", 0.5, by=["k"]))
    for k, g in got.groupby("k"):
        g = g.sort_values("ts")
        assert np.allclose(g["ewm"], g["y"].ewm(alpha=0.5, adjust=False).mean())


def test_holt_winters_tracks_exact_pattern(spark):
    out = _pdf(TS.holt_winters(_seasonal(spark), "ts", 12, 0.5, 0.3, 0.3, horizon=12))
    fut = out[out.step > 0].sort_values("step")
    t = 119 + fut["step"].to_numpy()
    truth = 100 + 2 * t + 10 * (t % 12)
    assert np.allclose(fut["fitted"], truth, rtol=0.02)


def test_forecasts_on_seasonal(spark):
    s = _seasonal(spark)
    t = 119 + np.arange(1, 13)
    truth = 100 + 2 * t + 10 * (t % 12)
    ts_ = _pdf(TS.forecast(s, "ts", 12, "trend_season", period=12)).sort_values("step")
    assert np.allclose(ts_["yhat"], truth, rtol=1e-3)
    sn = _pdf(TS.forecast(s, "ts", 12, "seasonal_naive", period=12)).sort_values("step")
    assert np.allclose(sn["yhat"], truth - 24)
    ar = _pdf(TS.forecast(s, "ts", 12, "ar", p=13)).sort_values("step")
    assert np.allclose(ar["yhat"], truth, rtol=1e-6)
    nv = _pdf(TS.forecast(s, "ts", 3, "naive")).sort_values("step")
    assert list(nv["ts"].dt.month) == [1, 2, 3]


def test_fill_gaps_modes(spark):
    g = spark.createDataFrame(pd.DataFrame({
        "ts": pd.to_datetime(["2024-01-01", "2024-01-02", "2024-01-05"]), "y": [1.0, 2.0, 5.0]})).select(
        F.col("ts").cast("timestamp_ntz").alias("ts"), "y")
    z = _pdf(TS.fill_gaps(g, "ts", "day", "zero")).sort_values("ts")
    assert list(z["y"]) == [1.0, 2.0, 0.0, 0.0, 5.0] and list(z["filled"]) == [False, False, True, True, False]
    f = _pdf(TS.fill_gaps(g, "ts", "day", "ffill")).sort_values("ts")
    assert list(f["y"]) == [1.0, 2.0, 2.0, 2.0, 5.0]


def test_acf_matches_numpy(spark):
    s = _seasonal(spark)
    got = _pdf(TS.acf(s, "ts", "month", 13)).sort_values("lag")
    y = _pdf(s).sort_values("ts")["y"].to_numpy()
    d = y - y.mean()
    ref = [np.sum(d[:-k] * d[k:]) / np.sum(d * d) for k in range(1, 14)]
    assert np.allclose(got["acf"], ref)


def test_permute_column_is_a_permutation(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 3 % 1000).alias("v"))
    p = _pdf(M.permute_column(df, "v", buckets=4))
    assert sorted(p["v"]) == sorted(_pdf(df)["v"])          # same multiset
    assert sorted(p["id"]) == list(range(1000))               # every row kept
    assert (p.sort_values("id")["v"].to_numpy() != (np.arange(1000) * 3 % 1000)).mean() > 0.99


def test_permutation_importance_finds_the_signal(spark):
    part = (read_table(spark, SF_TINY, "part")
            .withColumn("target", F.col("p_retailprice") + 3.0 * F.col("p_size"))
            .withColumn("noise", F.pmod(F.xxhash64("p_partkey"), F.lit(97))))
    xs = ["p_size", "noise"]
    model = M.REGRESSORS["linear"](0).fit(M._features(part, "target", xs))
    imp = {r["feature"]: r["importance"] for r in M.permutation_importance(
        model, part, "target", xs, classify=False).collect()}
    assert imp["p_size"] > 10 and abs(imp["noise"]) < 0.1 * imp["p_size"]


def test_permute_column_spreads_copies(spark):
    df = spark.range(4000).select(F.lit(1).alias("k"), F.lit(2.0).alias("v"))   # all rows identical
    x = M.permute_column(df, "v", buckets=8)
    assert x.count() == 4000
    sizes = (df.select(F.pmod(F.xxhash64("k", "v", F.monotonically_increasing_id(), F.lit(7)), F.lit(8)).alias("b"))
             .groupBy("b").count().collect())
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 1000
