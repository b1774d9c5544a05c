"""Recurrences as scans, the calendar's step numbers, ARIMA."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tally.functions.scan import Scan, ranges
from tally.operators import arima as A
from tally.operators import timeseries as TS

DAY0 = dt.datetime(2020, 1, 1)


def daily(spark, values, key=None, step=1):
    """Daily rows of one series; None leaves the step out, nan makes its value NULL."""
    rows = [(key, DAY0 + dt.timedelta(days=i * step), None if v != v else float(v)) for i, v in enumerate(values) if v is not None]
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, y double")


def pdf(df, *by):
    return df.toPandas().sort_values(list(by) or list(df.columns[:1])).reset_index(drop=True)


# ------------------------------------------------------------- step numbers
def test_sparse_days_are_counted_by_the_calendar(spark):
    """Values on days 1, 8, 11, 18, 21, 28, 30: gaps of 7, 3 and 2 days, never one."""
    days = [1, 8, 11, 18, 21, 28, 30]
    g = spark.createDataFrame([(DAY0 + dt.timedelta(days=d - 1), float(d)) for d in days], "ts timestamp_ntz, y double")
    assert sorted(r["idx"] for r in TS.with_index(g, "ts", "day").collect()) == [d - 1 for d in days]
    f = pdf(TS.forecast(g, "ts", 2, "drift", "day"), "step")
    assert f["yhat"].tolist() == pytest.approx([31.0, 32.0])
    lag = {r["y"]: (r["lag_1"], r["lag_3"], r["diff_1"]) for r in TS.lag_features(g, "ts", "day", [1, 3]).collect()}
    assert lag[11.0] == (None, 8.0, None) and lag[18.0] == (None, None, None) and lag[21.0] == (None, 18.0, None)
    ma = {r["y"]: r["ma"] for r in TS.moving_average(g, "ts", "day", 2, min_periods=1).collect()}
    assert ma == {float(d): float(d) for d in days}
    t = TS.linear_trend(g, "ts", "day").first()
    assert (t["n"], t["slope"], t["intercept"]) == (7, pytest.approx(1.0), pytest.approx(1.0))
    assert TS.backtest(g, "ts", 12, "drift", "day").first()["n"] == 3
    assert TS.backtest(g, "ts", 12, "drift", "day").first()["mae"] == pytest.approx(0.0, abs=1e-9)


@pytest.mark.parametrize("freq,stamps,steps", [
    ("hour", ["2024-01-01 05:00", "2024-01-01 06:00", "2024-01-03 05:00"], [0, 1, 48]),
    ("week", ["2024-01-01", "2024-01-08", "2024-02-05"], [0, 1, 5]),
    ("month", ["2023-11-01", "2024-01-01", "2024-02-29"], [0, 2, 3]),
    ("quarter", ["2023-10-01", "2024-04-01"], [0, 2]),
    ("year", ["1999-01-01", "2003-01-01"], [0, 4]),
    ("day", ["1960-01-01", "1960-02-01", "1970-01-01"], [0, 31, 3653])])
def test_step_numbers(spark, freq, stamps, steps):
    g = spark.createDataFrame([(s,) for s in stamps], "s string").select(F.col("s").cast("timestamp_ntz").alias("ts"))
    for kind in ("timestamp_ntz", "timestamp") + (() if freq == "hour" else ("date",)):
        got = TS.with_index(g.select(F.col("ts").cast(kind).alias("ts")), "ts", freq).orderBy("ts").collect()
        assert [r["idx"] for r in got] == steps, kind
    with pytest.raises(ValueError):
        TS.with_index(g, "ts", "fortnight")


# --------------------------------------------------------------------- scan
def test_a_scan_equals_the_recursion_on_a_million_steps(spark):
    n, a = 1_000_000, 0.01
    g = spark.range(n).select(F.timestamp_add("HOUR", F.col("id"), F.lit("1990-01-01").cast("timestamp_ntz")).alias("ts"),
                              (F.sin(F.col("id") / 37.0) * 50 + F.pmod(F.col("id") * 7919, F.lit(101))).alias("y"))
    got = TS.ewm(g, "ts", "hour", a)
    assert "applyInPandas" not in got._jdf.queryExecution().toString() and "FlatMapGroups" not in got._jdf.queryExecution().toString()
    p = pdf(got, "ts")
    assert len(p) == n
    ref = p["y"].ewm(alpha=a, adjust=False).mean()
    assert np.allclose(p["ewm"], ref, rtol=1e-10, atol=1e-10)


def smooth(y, period, a, b, g):
    """Additive smoothing of one series, plainly: one-step fits and the final state."""
    n = len(y)
    if period > 1:
        m0, m1 = np.nanmean(y[:period]), np.nanmean(y[period:2 * period])
        b0, mid = (m1 - m0) / period, (period - 1) / 2
        level, trend, begin = m0 + b0 * mid, b0, period
        season = [0.0 if np.isnan(y[k]) else y[k] - (m0 + b0 * (k - mid)) for k in range(period)]
    else:
        i, j = np.flatnonzero(~np.isnan(y))[:2]
        level, trend, season, begin = y[j], (y[j] - y[i]) / (j - i), [0.0], j + 1
    fits = np.full(n, np.nan)
    for t in range(begin, n):
        s = season[t % period]
        fits[t] = level + trend + s
        if np.isnan(y[t]):
            level += trend
            continue
        last = level
        level = a * (y[t] - s) + (1 - a) * (level + trend)
        trend = b * (level - last) + (1 - b) * trend
        if period > 1:
            season[t % period] = g * (y[t] - level) + (1 - g) * s
    return fits, level, trend, season


@pytest.mark.parametrize("period", [1, 4, 7])
def test_smoothing_equals_the_recursion_with_gaps_and_keys(spark, period):
    rng = np.random.default_rng(3)
    series = {}
    for key, n in (("a", 700), (None, 60), ("b", 33)):
        y = 50 + 0.3 * np.arange(n) + 8 * np.sin(np.arange(n)) + rng.normal(0, 2, n)
        y[rng.random(n) < 0.1] = np.nan
        y[[0, n - 1]] = 5.0
        series[key] = y
    df = None
    for key, y in series.items():  # every third missing step has a row with a NULL value, the others have none
        one = daily(spark, [None if np.isnan(v) and i % 3 else v for i, v in enumerate(y)], key)
        df = one if df is None else df.union(one)
    out = pdf(TS.holt_winters(df.withColumnRenamed("k", "n"), "ts", period, 0.4, 0.2, 0.3, horizon=9, freq="day", by=["n"]), "step")
    assert set(out.columns) == {"n", "step", "ts", "y", "fitted", "reason"}
    for key, y in series.items():
        fits, level, trend, season = smooth(y, period, 0.4, 0.2, 0.3)
        mine = out[out["n"].isna()] if key is None else out[out["n"] == key]
        past, future = mine[mine.step <= 0], mine[mine.step > 0]
        assert past["step"].tolist() == list(range(1 - len(y), 1))
        assert np.allclose(past["fitted"], fits, equal_nan=True, rtol=1e-9)
        want = [level + (h + 1) * trend + season[(len(y) + h) % period] for h in range(9)]
        assert np.allclose(future["fitted"], want, rtol=1e-9)
        assert (pd.to_datetime(mine["ts"]) == [DAY0 + dt.timedelta(days=len(y) - 1 + int(s)) for s in mine["step"]]).all()


def test_searched_parameters_have_the_least_error(spark):
    rng = np.random.default_rng(5)
    y = np.cumsum(rng.normal(0, 1, 90)) + 40
    out = pdf(TS.holt_winters(daily(spark, y), "ts", 1, None, None, freq="day"), "step")
    errors = {(a, b): np.nansum((smooth(y, 1, a, b, 0)[0] - y) ** 2) for a in np.arange(1, 10) / 10 for b in np.arange(1, 10) / 10}
    best = min(errors, key=errors.get)
    assert np.nansum((out["fitted"] - out["y"]) ** 2) == pytest.approx(errors[best], rel=1e-9)


def test_scan_of_series_without_steps_or_values(spark):
    empty = daily(spark, [])
    for g in (empty, daily(spark, [float("nan")] * 5)):
        rows = TS.ewm(g, "ts", "day", 0.5).collect()
        assert all(r["ewm"] is None for r in rows) and len(rows) == g.count()
        assert all(r["fitted"] is None for r in TS.holt_winters(g, "ts", 1, freq="day", horizon=2).collect())
    cells = empty.select("k", F.lit(0).cast("long").alias("idx"), F.struct("y").alias("cell"))
    steps = ranges(cells, empty.select("k", F.lit(0).cast("long").alias("n")), ["k"])
    one = spark.createDataFrame([("a", 0, [4.0])], "k string, variant int, state array<double>").withColumn("p", F.struct(F.lit(1).alias("z")))
    assert [r["state"] for r in Scan(steps, one, ["k"], 1, lambda s, x, p, i: s).final.collect()] == [[4.0]]
    assert Scan(steps, one.limit(0), ["k"], 1, lambda s, x, p, i: s).final.collect() == []


def test_ar_equals_least_squares(spark):
    rng = np.random.default_rng(8)
    y = [0.0, 0.0]
    for _ in range(400):
        y.append(3 + 0.6 * y[-1] - 0.3 * y[-2] + rng.normal())
    y = np.array(y)
    y[[50, 51, 200, 400]] = np.nan
    lags = np.array([[1, y[t - 1], y[t - 2], y[t]] for t in range(2, len(y))])
    lags = lags[~np.isnan(lags).any(axis=1)]
    c = np.linalg.lstsq(lags[:, :3], lags[:, 3], rcond=None)[0]
    hist = list(y)
    for t in range(2, len(hist)):
        if np.isnan(hist[t]):
            hist[t] = c[0] + c[1] * hist[t - 1] + c[2] * hist[t - 2]
    for _ in range(5):
        hist.append(c[0] + c[1] * hist[-1] + c[2] * hist[-2])
    f = pdf(TS.forecast(daily(spark, y), "ts", 5, "ar", "day", p=2), "step")
    assert np.allclose(f["yhat"], hist[-5:], rtol=1e-8)


# -------------------------------------------------------------------- ARIMA
def simulated(n, c, phi, theta, d, seed):
    rng = np.random.default_rng(seed)
    w, e = [], rng.normal(0, 1, n + 50)
    for t in range(n + 50):
        w.append(c + sum(f * w[t - 1 - i] for i, f in enumerate(phi) if t > i)
                 + e[t] + sum(q * e[t - 1 - j] for j, q in enumerate(theta) if t > j))
    y = np.array(w[50:])
    for _ in range(d):
        y = np.cumsum(y)
    return y


def css(y, d, c, phi, theta):
    w = np.diff(y, d) if d else y
    p, e = len(phi), np.zeros(len(w))
    for t in range(p, len(w)):
        e[t] = w[t] - c - sum(f * w[t - 1 - i] for i, f in enumerate(phi)) - sum(
            q * e[t - 1 - j] for j, q in enumerate(theta) if t > j)
    return float((e ** 2).sum()), e


@pytest.fixture(scope="module")
def planted(spark):
    """Two series with known coefficients and a short one."""
    ys = {"a": simulated(2000, 0.5, [0.6], [0.4], 1, 1), "b": simulated(2000, -0.2, [-0.5], [-0.3], 1, 2), "s": np.arange(4.0)}
    df = None
    for k, y in ys.items():
        df = daily(spark, y, k) if df is None else df.union(daily(spark, y, k))
    return df, ys


def test_arima_recovers_planted_coefficients(planted):
    df, ys = planted
    fit = {r["k"]: r for r in A.arima(df, "ts", "day", (1, 1, 1), by=["k"]).collect()}
    assert fit["s"]["ar1"] is None and fit["s"]["reason"]
    # 0.09 is three standard errors of ar1 at 2000 steps
    for k, c, phi, theta in (("a", 0.5, 0.6, 0.4), ("b", -0.2, -0.5, -0.3)):
        r = fit[k]
        assert r["ar1"] == pytest.approx(phi, abs=0.09) and r["ma1"] == pytest.approx(theta, abs=0.09)
        assert r["constant"] == pytest.approx(c, abs=0.15) and r["sigma2"] == pytest.approx(1.0, abs=0.08)
        found, _ = css(ys[k], 1, r["constant"], [r["ar1"]], [r["ma1"]])
        assert r["sigma2"] * r["n"] == pytest.approx(found, rel=1e-8)
        assert r["aic"] == pytest.approx(r["n"] * np.log(r["sigma2"]) + 8, rel=1e-9)
        for dc, dp, dq in ((.02, 0, 0), (-.02, 0, 0), (0, .02, 0), (0, -.02, 0), (0, 0, .02), (0, 0, -.02)):  # a minimum
            assert css(ys[k], 1, r["constant"] + dc, [r["ar1"] + dp], [r["ma1"] + dq])[0] >= found - 1e-6


def test_arima_forecasts_follow_the_recursion(planted):
    df, ys = planted
    fit = {r["k"]: r for r in A.arima(df, "ts", "day", (1, 1, 1), by=["k"]).collect()}
    out = pdf(A.forecast_arima(df, "ts", "day", 6, (1, 1, 1), by=["k"]), "k", "step")
    assert len(out) == 18 and out[out.k == "s"]["yhat"].isna().all() and out[out.k == "s"]["reason"].notna().all()
    for k in ("a", "b"):
        r, y = fit[k], ys[k]
        e = css(y, 1, r["constant"], [r["ar1"]], [r["ma1"]])[1][-1]
        w, level, want = np.diff(y)[-1], y[-1], []
        for h in range(6):
            w = r["constant"] + r["ar1"] * w + (r["ma1"] * e if h == 0 else 0)
            level += w
            want.append(level)
        assert np.allclose(out[out.k == k]["yhat"], want, rtol=1e-6)


def test_the_order_of_least_aic_is_chosen(spark):
    y = simulated(2500, 0.0, [0.7, -0.4], [], 0, 4)
    orders = [(0, 0, 0), (1, 0, 0), (2, 0, 0), (0, 0, 1)]
    out = A.choose_arima(daily(spark, y), "ts", "day", 3, orders).collect()
    assert [r["chosen"] for r in out] == ["(2,0,0)"] * 3 and all(r["yhat"] is not None for r in out)
    with pytest.raises(ValueError):
        A.choose_arima(daily(spark, y), "ts", "day", 3, [(0, 0, 0), (0, 1, 0)])


def test_arima_with_missing_steps_and_second_differences(spark):
    t = np.arange(300.0)
    y = 3 + 2 * t + 0.5 * t ** 2
    g = daily(spark, [None if i in (70, 71) else float("nan") if i == 150 else v for i, v in enumerate(y)])
    f = pdf(A.forecast_arima(g, "ts", "day", 4, (0, 2, 0)), "step")
    h = np.arange(300.0, 304)
    assert np.allclose(f["yhat"], 3 + 2 * h + 0.5 * h ** 2, rtol=1e-9)


# ---------------------------------------------------------------- sparse backtests
@pytest.mark.parametrize("method", ["naive", "drift", "mean", "seasonal_naive", "trend_season"])
def test_forecasts_at_given_times(spark, method):
    """The steps at some times are those of the whole horizon, for series with NULL keys and gaps too."""
    g = daily(spark, [1, 4, None, 2, 8, float("nan"), 5, 7, 3], "a").unionByName(daily(spark, [2, None, 3, 4, 9, 1, 6], None, 2))
    whole = TS.forecast(g, "ts", 40, method, "day", 2, by=["k"])
    at = whole.where("step in (1, 7, 40)").select("k", "ts").unionByName(g.select("k", "ts")).distinct()
    some = TS.forecast(g, "ts", 40, method, "day", 2, by=["k"], at=at)
    assert some.columns == whole.columns
    key = lambda r: (str(r["k"]), r["step"])
    assert sorted(some.collect(), key=key) == sorted(whole.where("step in (1, 7, 40)").collect(), key=key)
    one = g.where("k = 'a'").select("ts", "y")
    alone = TS.forecast(one, "ts", 40, method, "day", 2, at=at.where("k = 'a'").select("ts"))
    assert sorted(alone.collect()) == sorted(TS.forecast(one, "ts", 40, method, "day", 2).where("step in (1, 7, 40)").collect())


def test_backtest_does_not_list_every_step(spark):
    """400 series of two values, 300 000 steps held out: before, 120 million forecasts were made and broadcast."""
    rows = [(k, DAY0 + dt.timedelta(hours=h), float(h)) for k in range(400) for h in (0, 300_000 + k)]
    g = spark.createDataFrame(rows, "k long, ts timestamp_ntz, y double").repartition(4)
    out = TS.backtest(g, "ts", 300_000, "naive", "hour", by=["k"])
    assert "sequence(" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["k"]: (r["n"], r["mae"]) for r in out.collect()}
    # a step is scored only within the horizon from the series' last training step
    assert got == {k: ((1, 300_000.0) if k == 0 else (0, None)) for k in range(400)}


def test_package_is_shipped_once_from_threads(spark, monkeypatch):
    """Fits in parallel ship the package at the same time: one does, the others wait for it."""
    import threading
    import time

    from tally import session
    from tally.functions.stats import run_parallel

    sent, inside = [], []

    class Context:
        applicationId, master = "app-of-this-test", "local[1]"

        def addPyFile(self, path):
            inside.append(threading.get_ident())
            time.sleep(0.2)
            sent.append(path)

    class Session:
        sparkContext = Context()

    monkeypatch.setattr(session, "scratch_path", lambda s, name: session.tempfile.mkdtemp(prefix="tally-test-"))
    run_parallel(lambda _: session.ship_package(Session()), range(4))
    assert len(sent) == len(inside) == 1
