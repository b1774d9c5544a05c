"""Edge tables (FIXTURES.md section 3): empty, one row, constant column,
all NULL, NaN, ties — no operator may raise or invent values."""

import math

import pytest
from pyspark.sql import functions as F

from tally.operators import charts as C
from tally.operators import clean as K
from tally.operators import profile as P

SCHEMA = "id bigint, x double, y double, c string"


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "empty": spark.createDataFrame([], SCHEMA),
        "one": spark.createDataFrame([(1, 2.0, 3.0, "a")], SCHEMA),
        "constant": spark.createDataFrame([(i, 5.0, float(i), "k") for i in range(10)], SCHEMA),
        "all_null": spark.createDataFrame([(i, None, None, None) for i in range(5)], SCHEMA),
        "nan": spark.createDataFrame([(1, float("nan"), 1.0, "a"), (2, 4.0, 2.0, "b"), (3, 6.0, 3.0, "b")], SCHEMA),
        "ties": spark.createDataFrame([(i, float(i % 3), float(i % 3), str(i % 3)) for i in range(12)], SCHEMA),
    }


@pytest.mark.parametrize("name", ["empty", "one", "constant", "all_null", "nan", "ties"])
def test_profile_ops_do_not_raise(tables, name):
    df = tables[name]
    P.describe_numeric(df, ["x", "y"]).collect()
    P.describe_categorical(df, ["c"]).collect()
    P.overview(df, exact_distinct=True).collect()
    P.distribution(df, "x").collect()
    P.correlation(df, ["x", "y"]).collect()
    P.correlation(df, ["x", "y"], method="spearman").collect()
    P.ecdf(df, "x").collect()
    C.histogram_table(df, "x", bins=5).collect()
    C.box_table(df, "c", "x").collect()
    K.impute_mean(df, ["x"]).collect()
    K.impute_mode(df, ["c", "x"]).collect()
    K.flag_outliers(df, "x").collect()
    K.scale(df, ["x"], "standard").collect()
    K.scale(df, ["x"], "minmax").collect()


def test_constant_column_gives_null_correlation(tables):
    r = P.correlation(tables["constant"], ["x", "y"]).first()["r"]
    assert r is None


def test_nan_counts_as_missing(tables):
    d = P.describe_numeric(tables["nan"], ["x"]).first()
    assert d["count"] == 2 and d["mean"] == 5.0
    imp = {r["id"]: r["x"] for r in K.impute_mean(tables["nan"], ["x"]).collect()}
    assert imp[1] == 5.0


def test_constant_histogram_is_one_bin(tables):
    h = {r["bin"]: r["count"] for r in C.histogram_table(tables["constant"], "x", bins=4).collect()}
    assert h == {1: 10, 2: 0, 3: 0, 4: 0}


def test_ties_mode_and_top_take_smallest(tables):
    m = K.column_modes(tables["ties"], ["c", "x"]).first()
    assert m["_mode_c"] == "0" and m["_mode_x"] == 0.0
    top = P.describe_categorical(tables["ties"], ["c"]).first()
    assert top["top"] == "0" and top["freq"] == 4 and top["unique"] == 3


def test_all_null_describe(tables):
    d = P.describe_numeric(tables["all_null"], ["x"]).first()
    assert d["count"] == 0 and d["mean"] is None
    c = P.describe_categorical(tables["all_null"], ["c"]).first()
    assert c["count"] == 0 and c["top"] is None


def test_spearman_with_ties_matches_pandas(tables):
    import pandas as pd
    df = tables["ties"].withColumn("y", (F.col("id") % 5).cast("double"))
    got = P.correlation(df, ["x", "y"], method="spearman").first()["r"]
    p = pd.DataFrame([r.asDict() for r in df.collect()])
    ref = p["x"].rank().corr(p["y"].rank())
    assert math.isclose(got, ref, rel_tol=1e-12)


def test_drop_duplicates_keeps_first_by_order(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (2, "b")], "id bigint, t string")
    out = sorted((r["id"], r["t"]) for r in K.drop_duplicates(df, ["t"], ["id"]).collect())
    assert out == [(1, "a"), (2, "b")]


def test_convert_types_raise_mode(spark):
    df = spark.createDataFrame([("1",), ("x",)], "v string")
    assert [r["v"] for r in K.convert_types(df, {"v": "int"}).collect()] == [1, None]
    with pytest.raises(Exception):
        K.convert_types(df, {"v": "int"}, errors="raise").collect()


def test_ntz_truncation_ignores_session_time_zone(spark):
    from tally.operators.charts import time_key
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        df = spark.sql("SELECT timestamp_ntz'2024-03-10 02:30:00' AS ts")
        got = {f: df.select(time_key(df, "ts", f).alias("k")).first()["k"].isoformat()
               for f in ("hour", "day", "week", "month", "quarter", "year")}
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == {"hour": "2024-03-10T02:00:00", "day": "2024-03-10T00:00:00", "week": "2024-03-04T00:00:00",
                   "month": "2024-03-01T00:00:00", "quarter": "2024-01-01T00:00:00", "year": "2024-01-01T00:00:00"}


@pytest.mark.parametrize("k", [3, 40, 41, 100])
def test_correlation_is_pairwise_at_any_width(spark, k):
    """The same rule for few and for many columns: rows where both are present."""
    import numpy as np
    rng = np.random.default_rng(k)
    x = rng.normal(size=(200, k)) * 3 + 1e7
    x[:, 1] += 0.5 * (x[:, 0] - 1e7)
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 2] = 5.0
    cols = [f"v.{i}" for i in range(k)]
    df = spark.createDataFrame([[None if np.isnan(v) and j % 2 else float(v) for j, v in enumerate(r)] for r in x],
                               ", ".join(f"`{c}` double" for c in cols)).repartition(3)
    got = {(r["var_x"], r["var_y"]): r["r"] for r in P.correlation(df, full=True).collect()}
    assert len(got) == k * k
    for i in range(k):
        for j in range(i + 1):
            m = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            r = got[cols[i], cols[j]]
            assert r == got[cols[j], cols[i]]
            if 2 in (i, j):
                assert r is None
            else:
                assert math.isclose(r, np.corrcoef(x[m, i], x[m, j])[0, 1], rel_tol=1e-6, abs_tol=1e-9)


def test_missing_is_missing_everywhere(spark):
    """NULL and NaN mean the same to every operator; a NULL category is a category."""
    nan = float("nan")
    df = spark.createDataFrame([(1, nan, 1.0, None), (2, None, 2.0, None), (3, 4.0, 3.0, None), (4, 8.0, nan, "b"), (5, 4.0, 9.0, "a")], SCHEMA)
    assert {(r["variable"], r["n_null"]) for r in P.overview(df).collect()} == {("id", 0), ("x", 2), ("y", 1), ("c", 3)}
    assert [r["_mode_x"] for r in K.column_modes(df, ["x"]).collect()] == [4.0]
    assert sorted(r["x"] for r in K.impute_mode(df, ["x"]).collect()) == [4.0, 4.0, 4.0, 4.0, 8.0]
    bars = {r["category"]: (r["value"], r["rank"]) for r in C.bar_table(df, "c", None, "count", top=2).collect()}
    assert bars == {None: (3.0, 1), "a": (1.0, 2), "(other)": (1.0, None)}
    box = {r["category"]: r["n"] for r in C.box_table(df, "c", "x").collect()}
    assert box == {None: 1, "a": 1, "b": 1}
    grid = C.scatter_table(df, "x", "y", bins=2).collect()
    assert sum(r["count"] for r in grid) == 2 and not any(math.isnan(r["x_lo"]) for r in grid)
    wide = C.overlay_by_category(df, F.lit(1), "c", "x", values=["a"], agg="avg").first()
    assert (wide["a"], wide["(other)"]) == (4.0, 6.0)


def test_column_names_with_dots(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, None)], "`price.usd` double, `cat.x` string")
    assert P.describe_numeric(df).first()["count"] == 2
    P.distribution(df, "price.usd").collect()
    P.insights(df, ["price.usd"], ["cat.x"]).collect()
    C.histogram_table(df, "price.usd", 3).collect()
    C.bar_table(df, "cat.x", "price.usd").collect()
    K.impute_mean(df, ["price.usd"]).collect()
    K.impute_mode(df, ["cat.x"]).collect()
    assert K.flag_outliers(df, "price.usd").columns == ["price.usd", "cat.x", "is_outlier"]
    assert K.scale(df, ["price.usd"]).columns == df.columns
    assert K.drop_duplicates(df, ["cat.x"]).count() == 2


@pytest.fixture(scope="module")
def grids(spark):
    import datetime as dt

    def g(vals):
        rows = [(dt.datetime(2020, 1, 1) + dt.timedelta(days=31 * i), v) for i, v in enumerate(vals)]
        return spark.createDataFrame(rows, "ts timestamp_ntz, y double").select(
            C.time_key(spark.createDataFrame(rows, "ts timestamp_ntz, y double"), "ts", "month").alias("ts"), "y")
    return {"empty": spark.createDataFrame([], "ts timestamp_ntz, y double"), "one": g([5.0]),
            "constant": g([3.0] * 30), "short": g([1.0, 2.0, 3.0, 4.0, 5.0])}


@pytest.mark.parametrize("name", ["empty", "one", "constant", "short"])
def test_time_series_ops_do_not_raise(grids, name):
    from tally.operators import timeseries as TS
    g = grids[name]
    TS.fill_gaps(g, "ts", "month", "ffill").collect()
    TS.linear_trend(g, "ts", "month").collect()
    TS.decompose(g, "ts", "month", 12).collect()
    TS.decompose(g, "ts", "month", 12, "multiplicative").collect()
    TS.moving_average(g, "ts", "month", 3).collect()
    TS.ewm(g, "ts", "month", 0.5).collect()
    TS.holt_winters(g, "ts", 12, horizon=3).collect()
    for m in ("naive", "drift", "mean", "seasonal_naive", "trend_season", "ar"):
        TS.forecast(g, "ts", 3, m, period=12).collect()
    TS.backtest(g, "ts", 2, "naive").collect()
    TS.lag_features(g, "ts", "month", [1, 2]).collect()
    TS.acf(g, "ts", "month", 3).collect()


def test_constant_series_acf_is_null(grids):
    from tally.operators import timeseries as TS
    assert all(r["acf"] is None for r in TS.acf(grids["constant"], "ts", "month", 3).collect())


@pytest.mark.parametrize("name", ["empty", "one", "constant", "all_null"])
def test_chart_ops_do_not_raise(tables, name):
    df = tables[name]
    C.line_table(df, "id", "x").collect()
    C.bar_table(df, "c", "x", top=2).collect()
    C.scatter_table(df, "x", "y", bins=4).collect()
    C.share_table(df, "c", "x").collect()
    C.overlay_by_category(df, "id", "c", "x", values=["a", "b"]).collect()
    P.value_counts(df, "c", top=3).collect()
    P.metric_cards(df, {"n": F.count(F.lit(1)), "s": F.sum("x")}).collect()
    P.insights(df, ["x", "y"], ["c"]).collect()


def test_zero_denominators_give_null_not_errors(tables, grids):
    from tally.operators import timeseries as TS
    K.flag_outliers(tables["constant"], "x", "zscore").collect()
    zero = grids["constant"].withColumn("y", F.lit(0.0))
    TS.decompose(zero, "ts", "month", 12, "multiplicative").collect()
    P.insights(tables["empty"], ["x", "y"], ["c"]).collect()
