"""Model evaluation (M1-M7): model comparison, cross-validation, confusion
matrix, classification metrics, ROC / AUC, feature importance.

Fits are Spark ML estimators (distributed); metrics are Spark aggregates
over the prediction frame, so they stay lazy and scale with the test set.
ROC and AUC collapse tied scores with a grouped aggregate first, then run
the cumulative sums by range buckets (no single-partition window).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml import Pipeline
from pyspark.ml.feature import PolynomialExpansion, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tally.functions.stats import as_col, hash_bucket, join_on_keys, nan_to_null, run_parallel, running_sums
from tally.operators.regress import regression_metrics


def _features(df: DataFrame, label: str, xs: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    base = df.select(*keep, nan_to_null(label).alias("label"),
                     *[nan_to_null(x).alias(f"_x{i}") for i, x in enumerate(xs)]).na.drop(how="any")
    cols = [f"_x{i}" for i in range(len(xs))]
    return VectorAssembler(inputCols=cols, outputCol="features").transform(base).drop(*cols)


CLASSIFIERS = {
    "logistic": lambda seed: LogisticRegression(maxIter=100),
    "decision_tree": lambda seed: DecisionTreeClassifier(maxDepth=5, seed=seed),
    "random_forest": lambda seed: RandomForestClassifier(numTrees=50, maxDepth=6, seed=seed),
    "gbt": lambda seed: GBTClassifier(maxIter=30, maxDepth=4, seed=seed),
    "naive_bayes": lambda seed: NaiveBayes(modelType="gaussian"),
}

REGRESSORS = {
    "linear": lambda seed: LinearRegression(solver="normal"),
    "ridge": lambda seed: LinearRegression(regParam=0.1, elasticNetParam=0.0),
    "lasso": lambda seed: LinearRegression(regParam=0.1, elasticNetParam=1.0),
    "polynomial": lambda seed: Pipeline(stages=[
        StandardScaler(withMean=True, inputCol="features", outputCol="_z"),
        PolynomialExpansion(degree=2, inputCol="_z", outputCol="_p"),
        LinearRegression(solver="normal", featuresCol="_p")]),
    "decision_tree": lambda seed: DecisionTreeRegressor(maxDepth=6, seed=seed),
    "random_forest": lambda seed: RandomForestRegressor(numTrees=50, maxDepth=6, seed=seed),
    "gbt": lambda seed: GBTRegressor(maxIter=30, maxDepth=4, seed=seed),
}


# --------------------------------------------------------------------- M1
def compare_classifiers(train: DataFrame, test: DataFrame, label: str, xs: Sequence[str],
                        models: Sequence[str] = tuple(CLASSIFIERS), seed: int = 42,
                        positive: float = 1.0, parallelism: int = 4) -> DataFrame:
    """Fit each binary classifier on ``train``; score on ``test``:
    (model, accuracy, precision, recall, f1, auc).  ``train`` is cached and
    the fits run as concurrent Spark jobs."""
    tr = _features(train, label, xs).persist()
    te = _features(test, label, xs)
    fitted = run_parallel(lambda name: CLASSIFIERS[name](seed).fit(tr), models, parallelism)
    tr.unpersist()  # only the fits read it
    # every model's predictions from one scan of the test set, scored by one grouped pass
    scored = te.select("label", "features")
    for i, m in enumerate(fitted):
        scored = (m.transform(scored).withColumn(f"_p{i}", F.col("prediction"))
                  .withColumn(f"_s{i}", vector_to_array("probability")[int(positive)])
                  .select("label", "features", *[f"_{k}{j}" for j in range(i + 1) for k in "ps"]))
    long = scored.select("label", F.inline(F.array(*[
        F.struct(F.lit(name).alias("model"), F.col(f"_p{i}").alias("prediction"), F.col(f"_s{i}").alias("score"))
        for i, name in enumerate(models)])))
    cm = classification_metrics(long, "label", "prediction", positive, by=["model"])
    return cm.join(auc(long, "label", "score", positive, by=["model"]), "model").select(
        "model", "accuracy", "precision", "recall", "f1", "auc")


# --------------------------------------------------------------------- M2
def compare_regressors(train: DataFrame, test: DataFrame, label: str, xs: Sequence[str],
                       models: Sequence[str] = tuple(REGRESSORS), seed: int = 42,
                       parallelism: int = 4) -> DataFrame:
    """(model, r2, mse, rmse, mae) on ``test`` for each regressor; the fits
    run as concurrent Spark jobs on the cached training set."""
    tr = _features(train, label, xs).persist()
    te = _features(test, label, xs)
    fitted = run_parallel(lambda name: REGRESSORS[name](seed).fit(tr), models, parallelism)
    tr.unpersist()  # only the fits read it
    scored = te.select("label", "features")
    for i, m in enumerate(fitted):
        scored = (m.transform(scored).withColumn(f"_p{i}", F.col("prediction"))
                  .select("label", "features", *[f"_p{j}" for j in range(i + 1)]))
    long = scored.select("label", F.inline(F.array(*[
        F.struct(F.lit(name).alias("model"), F.col(f"_p{i}").alias("prediction")) for i, name in enumerate(models)])))
    return regression_metrics(long, "label", "prediction", by=["model"]).select("model", "r2", "mse", "rmse", "mae")


# --------------------------------------------------------------------- M3
def cross_validate(df: DataFrame, label: str, xs: Sequence[str], k: int = 5, key: str | None = None,
                   model: str = "linear", seed: int = 42, parallelism: int = 4, positive: float = 1.0,
                   classify: bool | None = None) -> DataFrame:
    """k-fold cross-validation with one row per fold: fold, n_train, n_test,
    then r2, rmse, mae for a regressor or accuracy, precision, recall, f1 for
    a classifier.  ``classify`` chooses where both kinds have a model of that
    name (a regressor by default).  Fold = ``functions.stats.hash_bucket`` of the key, so folds
    do not depend on partitioning or on how keys are numbered (CrossValidator
    only reports the mean; the per-fold rows need the loop).  A fold without
    test rows has no row; one without training rows has NULL metrics."""
    if key is None:
        raise ValueError("cross_validate needs a key column for repeatable folds")
    classify = model not in REGRESSORS if classify is None else classify
    kind = CLASSIFIERS if classify else REGRESSORS
    if model not in kind:
        raise ValueError(f"unknown model {model!r}")
    make = kind[model]
    data = _features(df.withColumn("_fold", hash_bucket(as_col(key), k)), label, xs, keep=["_fold"]).persist()
    sizes = {r["_fold"]: r["n"] for r in data.groupBy("_fold").agg(F.count(F.lit(1)).alias("n")).collect()}  # k rows
    n = sum(sizes.values())
    folds = [f for f in sorted(sizes) if sizes[f] < n]
    models = run_parallel(lambda f: make(seed).fit(data.where(F.col("_fold") != f)), folds, parallelism)
    data.unpersist()
    # one scan: every row is scored by the model that has not seen its fold
    frame, preds = _features(df.withColumn("_fold", hash_bucket(as_col(key), k)), label, xs, keep=["_fold"]), None
    scored = frame.select("_fold", "label", "features", F.lit(None).cast("double").alias("yhat"))
    for f, m in zip(folds, models):
        scored = m.transform(scored).select(
            "_fold", "label", "features", F.when(F.col("_fold") == f, F.col("prediction")).otherwise(F.col("yhat")).alias("yhat"))
    preds = scored.select("_fold", "label", F.col("yhat").alias("prediction"))
    if not classify:
        per = regression_metrics(preds, "label", "prediction", by=["_fold"])
        metrics = ["r2", "rmse", "mae"]
    else:
        per = classification_metrics(preds, "label", "prediction", positive, by=["_fold"])
        metrics = ["accuracy", "precision", "recall", "f1"]
    return per.select(F.col("_fold").cast("long").alias("fold"), (F.lit(n).cast("long") - F.col("n")).alias("n_train"),
                      F.col("n").alias("n_test"), *metrics)


# ------------------------------------------------------------------ M4 M5
def confusion_matrix(pred: DataFrame, label: str = "label", yhat: str = "prediction",
                     zero_cells: bool = True) -> DataFrame:
    """Long form (label, prediction, count) over every pair of classes seen
    in either column, zero cells included; NULL is a class of its own when it
    occurs, so the counts add up to the rows.  The classes are a distinct
    aggregate; their square is the table asked for.  With many classes ask for the cells that
    occur alone (``zero_cells=False``): one grouped aggregate, never more rows than ``pred``."""
    counts = pred.groupBy(as_col(label).alias("label"), as_col(yhat).alias("prediction")).agg(
        F.count(F.lit(1)).alias("count"))
    if not zero_cells:
        return counts
    classes = (counts.select(F.col("label").alias("c")).unionByName(counts.select(F.col("prediction").alias("c"))).distinct())
    grid = classes.select(F.col("c").alias("label")).crossJoin(classes.select(F.col("c").alias("prediction")))
    return (join_on_keys(grid, counts, ["label", "prediction"], "left")
            .select("label", "prediction", F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


def classification_metrics(pred: DataFrame, label: str = "label", yhat: str = "prediction",
                           positive: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """n, accuracy, and precision / recall / F1 of the ``positive`` class (per ``by`` group)."""
    y, p = as_col(label), as_col(yhat)
    one = pred.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(y == p).alias("_ok"),
        F.count_if((p == positive) & (y == positive)).alias("_tp"),
        F.count_if((p == positive) & (y != positive)).alias("_fp"),
        F.count_if((p != positive) & (y == positive)).alias("_fn"))
    prec = F.try_divide(F.col("_tp"), F.col("_tp") + F.col("_fp"))
    rec = F.try_divide(F.col("_tp"), F.col("_tp") + F.col("_fn"))
    return one.select(*by, "n", F.try_divide(F.col("_ok"), F.col("n")).alias("accuracy"),
                      prec.alias("precision"), rec.alias("recall"),
                      F.try_divide(2 * F.col("_tp"), 2 * F.col("_tp") + F.col("_fp") + F.col("_fn")).alias("f1"))


def class_report(pred: DataFrame, label: str = "label", yhat: str = "prediction") -> DataFrame:
    """Per class (of either column, as text) support, precision, recall and
    F1, and a row ``(macro)`` with their means over the classes that have
    them.  One grouped aggregate over the rows; NULL labels and predictions
    count as errors of the other side's class but are no class."""
    y, p = as_col(label).cast("string"), as_col(yhat).cast("string")
    cells = pred.groupBy(y.alias("y"), p.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(F.inline(F.array(
        F.struct(F.col("y").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("long").alias("hit"))))).where(F.col("class").isNotNull())
    per = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hit")]).select(
        "class", "support", F.try_divide("hit", "predicted").alias("precision"), F.try_divide("hit", "support").alias("recall"),
        F.try_divide(2 * F.col("hit"), F.col("support") + F.col("predicted")).alias("f1"))
    macro = per.agg(F.lit("(macro)").alias("class"), F.coalesce(F.sum("support"), F.lit(0)).alias("support"),
                    *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])
    return per.unionByName(macro)


# ------------------------------------------------------------------ M6
def _score_counts(pred: DataFrame, label: str, score: str, positive: float, by: Sequence[str] = ()) -> DataFrame:
    s = pred.select(*by, nan_to_null(score).alias("threshold"),
                    (as_col(label) == positive).cast("long").alias("_p")).where(F.col("threshold").isNotNull())
    return s.groupBy(*by, "threshold").agg(F.sum("_p").alias("pos"), F.sum(1 - F.col("_p")).alias("neg"))


def roc_curve(pred: DataFrame, label: str = "label", score: str = "score", positive: float = 1.0,
              buckets: int | None = None, max_points: int | None = None) -> DataFrame:
    """One point per distinct score (ties collapse), thresholds descending,
    plus the (0, 0) start: threshold, tp, fp, tpr, fpr.

    ``max_points`` bounds the table: the scores are cut into that many bins
    of equal numbers of rows, and every bin gives its last point, so all
    scores count and the curve's end stays (1, 1)."""
    g = _score_counts(pred, label, score, positive)
    tot = g.agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    cum = running_sums(g, "threshold", ["pos", "neg"], descending=True, buckets=buckets, unique_order=True)
    pts = cum.crossJoin(F.broadcast(tot))
    if max_points:
        done = F.col("cum_pos") + F.col("cum_neg")
        pts = pts.groupBy(F.ceil(done * F.lit(max_points) / (F.col("_P") + F.col("_N"))).alias("_bin"), "_P", "_N").agg(
            F.min("threshold").alias("threshold"), F.max("cum_pos").alias("cum_pos"), F.max("cum_neg").alias("cum_neg"))
    pts = pts.select(
        "threshold", F.col("cum_pos").cast("long").alias("tp"), F.col("cum_neg").cast("long").alias("fp"),
        F.try_divide(F.col("cum_pos"), F.col("_P")).alias("tpr"), F.try_divide(F.col("cum_neg"), F.col("_N")).alias("fpr"))
    start = tot.select(F.lit(None).cast("double").alias("threshold"), F.lit(0).cast("long").alias("tp"),
                       F.lit(0).cast("long").alias("fp"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr"))
    return start.unionByName(pts)


def auc(pred: DataFrame, label: str = "label", score: str = "score", positive: float = 1.0,
        buckets: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve (trapezoids over tied scores = Mann-Whitney
    with ties counted half): sum_s neg_s (pos_above_s + pos_s / 2) / (P N).
    ``score`` is higher the likelier the ``positive`` class."""
    g = _score_counts(pred, label, score, positive, by)
    cum = running_sums(g, "threshold", ["pos"], by=by, descending=True, buckets=buckets, unique_order=True)
    one = cum.groupBy(*by).agg(F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0)).alias("_u"),
                               F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return one.select(*by, F.try_divide(F.col("_u"), F.col("n_pos") * F.col("n_neg")).alias("auc"),
                      F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg"))


# --------------------------------------------------------------------- M7
def feature_importance(model, xs: Sequence[str]) -> DataFrame:
    """(feature, importance) from a tree ensemble; importances sum to 1."""
    imp = model.featureImportances.toArray()
    spark = getattr(model, "spark_session", None) or SparkSession.getActiveSession()
    return spark.createDataFrame([(x, float(v)) for x, v in zip(xs, imp)], "feature string, importance double")


def fit_forest(df: DataFrame, label: str, xs: Sequence[str], classify: bool = True, seed: int = 42):
    data = _features(df, label, xs).persist()  # a fit reads it for its classes, its size, its splits and its trees
    est = (RandomForestClassifier(numTrees=50, maxDepth=6, seed=seed) if classify
           else RandomForestRegressor(numTrees=50, maxDepth=6, seed=seed))
    try:
        model = est.fit(data)
    finally:
        data.unpersist()
    model.spark_session = df.sparkSession
    return model


def permute_column(df: DataFrame, col: str, seed: int = 7, buckets: int | None = None,
                   key: Sequence[str] | None = None) -> DataFrame:
    """``df`` with ``col`` permuted across rows, distributed: rows are hashed
    into buckets by ``key`` and, inside each bucket (ordered by a second
    hash), every row takes the value of the next row (the last takes the
    first).  No global row number (which would be one partition).  The result
    depends on the rows alone, not on their layout.  Without ``key`` the whole
    row is the key; give the rows' own key where many rows are equal, so that
    copies spread.  Buckets hold about 50 000 rows each, however many there are."""
    n_b = buckets or 1 + df.count() // 50_000
    cols = [as_col(c) for c in (key or df.columns)]
    h = F.xxhash64(*cols, F.lit(seed))
    x = df.withColumn("_b", F.pmod(h, F.lit(n_b))).withColumn("_o", F.xxhash64(h, F.lit(seed + 1)))
    w = Window.partitionBy("_b").orderBy("_o", *[as_col(c) for c in df.columns])
    last = Window.partitionBy("_b").orderBy("_o", *[as_col(c) for c in df.columns]).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    # a struct tells a missing next row from a NULL value
    nxt = F.coalesce(F.lead(F.struct(as_col(col).alias("v")), 1).over(w), F.first(F.struct(as_col(col).alias("v"))).over(last))
    return x.withColumn("_nxt", nxt).withColumn(col, F.col("_nxt.v")).drop("_b", "_o", "_nxt")


def permutation_importance(model, df: DataFrame, label: str, xs: Sequence[str], classify: bool = True,
                           seed: int = 7, key: Sequence[str] | None = None) -> DataFrame:
    """(feature, baseline, permuted, importance): the drop in accuracy
    (classifiers) or rise in RMSE (regressors) when one feature is permuted
    on ``df`` (a held-out set), one distributed permutation per feature.
    ``key`` as in :func:`permute_column`."""
    base = df.select(*[as_col(c) for c in dict.fromkeys([*(key or ()), label, *xs])])
    buckets = 1 + base.count() // 50_000
    frames = [_features(base, label, xs).withColumn("_which", F.lit(""))]
    frames += [_features(permute_column(base, x, seed, buckets, key), label, xs).withColumn("_which", F.lit(x)) for x in xs]
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f)
    p = model.transform(every).select("_which", "label", "prediction")
    e = F.col("label") - F.col("prediction")
    s = F.avg((e == 0).cast("double")) if classify else F.sqrt(F.avg(e * e))
    scored = p.groupBy("_which").agg(s.alias("s"))
    baseline = scored.where("_which = ''").select(F.col("s").alias("baseline"))  # one row
    drop = F.col("baseline") - F.col("s")
    return scored.where("_which != ''").crossJoin(F.broadcast(baseline)).select(
        F.col("_which").alias("feature"), "baseline", F.col("s").alias("permuted"),
        (drop if classify else -drop).alias("importance"))
