"""Registered queries T1-T12 (time series) and the flagship plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from tally.operators import arima as AR
from tally.operators import timeseries as TS
from tally.plans.catalog import register
from tally.sources.files import read_table

TS_COL = "o_orderdate"
_M = ("SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS o_orderdate, sum(o_totalprice) AS y "
      "FROM orders GROUP BY 1")
_D = ("SELECT CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS o_orderdate, sum(o_totalprice) AS y "
      "FROM orders GROUP BY 1")
_W = "OVER (ORDER BY o_orderdate)"


def monthly_revenue(spark, sf):
    return TS.resample(read_table(spark, sf, "orders"), TS_COL, "o_totalprice", "month", "sum")


def daily_revenue(spark, sf):
    return TS.resample(read_table(spark, sf, "orders"), TS_COL, "o_totalprice", "day", "sum")


# --------------------------------------------------------------------- T1
@register("t1_resample", _M, ["y"])
def t1(spark, sf):
    return monthly_revenue(spark, sf)


@register("t1_resample_by", "SELECT o_orderstatus, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS o_orderdate, "
                            "CAST(count(*) AS DOUBLE) AS y FROM orders GROUP BY 1, 2", ["y"])
def t1_by(spark, sf):
    return TS.resample(read_table(spark, sf, "orders"), TS_COL, None, "day", "count", by=["o_orderstatus"])


@register("t1_resample_hourly", "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, avg(value) AS y "
                                "FROM events GROUP BY 1", ["y"])
def t1_hourly(spark, sf):
    return TS.resample(read_table(spark, sf, "events"), "ts", "value", "hour", "avg")


# --------------------------------------------------------------------- T2
@register("t2_slot_profile", "SELECT CAST(hour(ts) AS BIGINT) AS slot, avg(value) AS y, count(*) AS n "
                             "FROM events GROUP BY 1", ["y"])
def t2(spark, sf):
    return TS.slot_profile(read_table(spark, sf, "events"), "ts", "value", "hour")


@register("t2_slot_profile_weekday", "SELECT CAST(isodow(o_orderdate) AS BIGINT) AS slot, sum(o_totalprice) AS y, "
                                     "count(*) AS n FROM orders GROUP BY 1", ["y"])
def t2_dow(spark, sf):
    return TS.slot_profile(read_table(spark, sf, "orders"), TS_COL, "o_totalprice", "dow", "sum")


# --------------------------------------------------------------------- T3
_FULL = (f"WITH d AS ({_D}), b AS (SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM d), "
         "f AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS o_orderdate FROM b) ")


@register("t3_fill_gaps", _FULL + "SELECT f.o_orderdate, coalesce(d.y, 0.0) AS y, d.y IS NULL AS filled "
                                  "FROM f LEFT JOIN d ON f.o_orderdate = d.o_orderdate", ["y"])
def t3(spark, sf):
    return TS.fill_gaps(daily_revenue(spark, sf), TS_COL, "day", "zero")


@register("t3_fill_gaps_ffill", _FULL + "SELECT f.o_orderdate, last_value(d.y IGNORE NULLS) OVER (ORDER BY f.o_orderdate "
                                        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y, d.y IS NULL AS filled "
                                        "FROM f LEFT JOIN d ON f.o_orderdate = d.o_orderdate", ["y"])
def t3_ffill(spark, sf):
    return TS.fill_gaps(daily_revenue(spark, sf), TS_COL, "day", "ffill")


# --------------------------------------------------------------------- T4
_IDX = f"WITH m AS ({_M}), g AS (SELECT o_orderdate, y, CAST(row_number() {_W} - 1 AS DOUBLE) AS idx FROM m) "


@register("t4_linear_trend", _IDX + "SELECT count(y) AS n, regr_slope(y, idx) AS slope, regr_intercept(y, idx) "
                                    "AS intercept, regr_r2(y, idx) AS r2 FROM g", ["slope", "intercept", "r2"])
def t4(spark, sf):
    return TS.linear_trend(monthly_revenue(spark, sf), TS_COL, "month")


# --------------------------------------------------------------------- T5
def _decompose_sql(model: str, src: str = _M, extra: str = "") -> str:
    frame = "OVER (ORDER BY o_orderdate ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)"
    detr = "y - trend" if model == "additive" else "y / trend"
    cen = "s - (SELECT avg(s) FROM raw)" if model == "additive" else "s / (SELECT avg(s) FROM raw)"
    resid = "y - trend - seasonal" if model == "additive" else "y / (trend * seasonal)"
    return (f"WITH m AS ({src}), g AS (SELECT o_orderdate, y, row_number() {_W} - 1 AS idx, "
            f"CASE WHEN count(y) {frame} = 13 THEN (sum(y) {frame} - 0.5 * (lag(y, 6) {_W} + lead(y, 6) {_W})) / 12 "
            f"END AS trend{extra} FROM m), "
            f"raw AS (SELECT idx % 12 AS phase, avg({detr}) AS s FROM g GROUP BY 1), "
            f"seas AS (SELECT phase, {cen} AS seasonal FROM raw) "
            f"SELECT o_orderdate, y, trend, seasonal, {resid} AS resid"
            + (", ma" if extra else "")
            + " FROM g LEFT JOIN seas ON g.idx % 12 = seas.phase")


@register("t5_decompose", _decompose_sql("additive"), ["y", "trend", "seasonal", "resid"])
def t5(spark, sf):
    return TS.decompose(monthly_revenue(spark, sf), TS_COL, "month", 12, "additive")


@register("t5_decompose_mult", _decompose_sql("multiplicative"), ["y", "trend", "seasonal", "resid"])
def t5_mult(spark, sf):
    return TS.decompose(monthly_revenue(spark, sf), TS_COL, "month", 12, "multiplicative")


_MA3 = (", CASE WHEN count(y) OVER (ORDER BY o_orderdate ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 3 "
        "THEN avg(y) OVER (ORDER BY o_orderdate ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS ma")


def decompose_with_ma(spark, sf):
    """Flagship: monthly revenue -> decomposition (period 12) with a 3-month
    trailing average over the same grid."""
    dec = TS.decompose(monthly_revenue(spark, sf), TS_COL, "month", 12, "additive")
    return TS.moving_average(dec, TS_COL, "month", 3)


@register("t5_decompose_with_ma", _decompose_sql("additive", extra=_MA3), ["y", "trend", "seasonal", "resid", "ma"])
def t5_ma(spark, sf):
    return decompose_with_ma(spark, sf)


# --------------------------------------------------------------------- T6
_W7 = "OVER (ORDER BY f.o_orderdate ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"


@register("t6_moving_average", _FULL + f"SELECT o_orderdate, y, filled, CASE WHEN count(y) {_W7.replace('f.', '')} >= 7 "
                                       f"THEN avg(y) {_W7.replace('f.', '')} END AS ma FROM ("
                                       "SELECT f.o_orderdate, coalesce(d.y, 0.0) AS y, d.y IS NULL AS filled "
                                       "FROM f LEFT JOIN d ON f.o_orderdate = d.o_orderdate) AS z", ["y", "ma"])
def t6(spark, sf):
    filled = TS.fill_gaps(daily_revenue(spark, sf), TS_COL, "day", "zero")
    return TS.moving_average(filled, TS_COL, "day", 7)


# --------------------------------------------------------------------- T7
_EWM_SQL = (f"WITH RECURSIVE m AS ({_M}), g AS (SELECT row_number() {_W} AS i, o_orderdate, y FROM m), "
            "r AS (SELECT i, o_orderdate, y, y AS ewm FROM g WHERE i = 1 UNION ALL "
            "SELECT g.i, g.o_orderdate, g.y, 0.3 * g.y + (1.0 - 0.3) * r.ewm FROM g JOIN r ON g.i = r.i + 1) "
            "SELECT o_orderdate, y, ewm FROM r")


@register("t7_ewm", _EWM_SQL, ["y", "ewm"])
def t7(spark, sf):
    return TS.ewm(monthly_revenue(spark, sf), TS_COL, "month", 0.3)


# --------------------------------------------------------------------- T8
_HW = (f"WITH RECURSIVE m AS ({_M}), g AS (SELECT o_orderdate, y, CAST(row_number() {_W} - 1 AS INTEGER) AS idx FROM m), "
       "z AS (SELECT avg(CASE WHEN idx < 12 THEN y END) AS m0, (avg(CASE WHEN idx BETWEEN 12 AND 23 THEN y END) "
       "- avg(CASE WHEN idx < 12 THEN y END)) / 12 AS b0, CAST(max(idx) AS INTEGER) AS last, max(o_orderdate) AS final FROM g), "
       "r AS (SELECT 11 AS t, CAST(NULL AS DOUBLE) AS fitted, m0 + b0 * 5.5 AS l, b0 AS b, (SELECT list(y - (m0 + b0 * (idx - 5.5)) "
       "ORDER BY idx) FROM g WHERE idx < 12) AS s FROM z UNION ALL "
       "SELECT idx, f, l2, 0.1 * (l2 - l) + (1.0 - 0.1) * b, s[2:] || [0.2 * (y - l2) + (1.0 - 0.2) * s[1]] FROM ("
       "SELECT g.idx, g.y, r.l, r.b, r.s, r.l + r.b + r.s[1] AS f, 0.3 * (g.y - r.s[1]) + (1.0 - 0.3) * (r.l + r.b) AS l2 "
       "FROM g JOIN r ON g.idx = r.t + 1)), "
       "o AS (SELECT CAST(g.idx - z.last AS BIGINT) AS step, g.y, r.fitted FROM g CROSS JOIN z LEFT JOIN r ON r.t = g.idx UNION ALL "
       "SELECT h, CAST(NULL AS DOUBLE), l + h * b + s[CAST((h - 1) % 12 + 1 AS INTEGER)] FROM r JOIN z ON r.t = z.last, range(1, 13) AS x(h)) ")


@register("t8_holt_winters", _HW + "SELECT step, final + to_months(CAST(step AS INTEGER)) AS o_orderdate, y, fitted, "
                                   "CAST(NULL AS VARCHAR) AS reason FROM o, z", ["y", "fitted"], digits=7)
def t8(spark, sf):
    return TS.holt_winters(monthly_revenue(spark, sf), TS_COL, 12, 0.3, 0.1, 0.2, horizon=12, freq="month")


# --------------------------------------------------------------------- T9
_H = "range(1, 13) AS r(h)"
_NAIVE = (f"WITH m AS ({_M}), s AS (SELECT max(o_orderdate) AS last, arg_max(y, o_orderdate) AS last_y, "
          "arg_min(y, o_orderdate) AS first_y, count(*) AS n, avg(y) AS mean FROM m) "
          "SELECT h AS step, last + to_months(CAST(h AS INTEGER)) AS o_orderdate, {e} AS yhat FROM s, " + _H)


@register("t9_forecast_naive", _NAIVE.format(e="last_y"), ["yhat"])
def t9_naive(spark, sf):
    return TS.forecast(monthly_revenue(spark, sf), TS_COL, 12, "naive", "month")


@register("t9_forecast_drift", _NAIVE.format(e="last_y + h * (last_y - first_y) / (n - 1)"), ["yhat"])
def t9_drift(spark, sf):
    return TS.forecast(monthly_revenue(spark, sf), TS_COL, 12, "drift", "month")


@register("t9_forecast_mean", _NAIVE.format(e="mean"), ["yhat"])
def t9_mean(spark, sf):
    return TS.forecast(monthly_revenue(spark, sf), TS_COL, 12, "mean", "month")


_SNAIVE = (f"WITH m AS ({_M}), t AS (SELECT y, row_number() OVER (ORDER BY o_orderdate DESC) AS rn FROM m) "
           "SELECT h AS step, (SELECT max(o_orderdate) FROM m) + to_months(CAST(h AS INTEGER)) AS o_orderdate, "
           f"t.y AS yhat FROM {_H} LEFT JOIN t ON t.rn = 12 - (h - 1) % 12")


@register("t9_forecast_seasonal_naive", _SNAIVE, ["yhat"])
def t9_snaive(spark, sf):
    return TS.forecast(monthly_revenue(spark, sf), TS_COL, 12, "seasonal_naive", "month", period=12)


_TS_SQL = (_decompose_sql("additive").replace("SELECT o_orderdate, y, trend, seasonal, y - trend - seasonal AS resid "
                                              "FROM g LEFT JOIN seas ON g.idx % 12 = seas.phase", "")
           + ", tr AS (SELECT count(*) AS n, max(o_orderdate) AS last, regr_slope(trend, CAST(idx AS DOUBLE)) AS slope, "
           "regr_intercept(trend, CAST(idx AS DOUBLE)) AS intercept FROM g) "
           "SELECT h AS step, last + to_months(CAST(h AS INTEGER)) AS o_orderdate, "
           f"intercept + slope * (n - 1 + h) + seasonal AS yhat FROM tr CROSS JOIN {_H} "
           "LEFT JOIN seas ON seas.phase = (n - 1 + h) % 12")


@register("t9_forecast_trend_season", _TS_SQL, ["yhat"])
def t9_ts(spark, sf):
    return TS.forecast(monthly_revenue(spark, sf), TS_COL, 12, "trend_season", "month", period=12)


@register("t9_forecast_ar")
def t9_ar(spark, sf):
    return TS.forecast(monthly_revenue(spark, sf), TS_COL, 12, "ar", "month", p=2)


@register("t9_forecast_holt_winters", _HW + "SELECT step, final + to_months(CAST(step AS INTEGER)) AS o_orderdate, fitted AS yhat, "
                                            "CAST(NULL AS VARCHAR) AS reason FROM o, z WHERE step > 0", ["yhat"], digits=7)
def t9_hw(spark, sf):
    return TS.forecast(monthly_revenue(spark, sf), TS_COL, 12, "holt_winters", "month", period=12)


# -------------------------------------------------------------------- T10
_BT = (f"WITH m AS ({_M}), r AS (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC) AS rn FROM m), "
       "train AS (SELECT o_orderdate, y, row_number() OVER (ORDER BY o_orderdate DESC) AS trn FROM r WHERE rn > 12), "
       "lt AS (SELECT max(o_orderdate) AS last FROM train), "
       f"fc AS (SELECT lt.last + to_months(CAST(h AS INTEGER)) AS ts, t.y AS yhat FROM lt CROSS JOIN {_H} "
       "LEFT JOIN train AS t ON t.trn = 12 - (h - 1) % 12), "
       "test AS (SELECT o_orderdate AS ts, y AS actual FROM r WHERE rn <= 12) "
       "SELECT count(*) AS n, avg(abs(actual - yhat)) AS mae, sqrt(avg((actual - yhat) * (actual - yhat))) AS rmse, "
       "avg(CASE WHEN actual <> 0 THEN abs((actual - yhat) / actual) END) AS mape FROM fc JOIN test USING (ts)")


@register("t10_backtest", _BT, ["mae", "rmse", "mape"])
def t10(spark, sf):
    return TS.backtest(monthly_revenue(spark, sf), TS_COL, 12, "seasonal_naive", "month", period=12)


# -------------------------------------------------------------------- T11
@register("t11_lag_features", f"WITH m AS ({_M}) SELECT o_orderdate, y, lag(y, 1) {_W} AS lag_1, "
                              f"lag(y, 12) {_W} AS lag_12, y - lag(y, 1) {_W} AS diff_1, "
                              f"CASE WHEN lag(y, 1) {_W} <> 0 THEN (y - lag(y, 1) {_W}) / lag(y, 1) {_W} END "
                              "AS pct_change_1 FROM m", ["y", "lag_1", "lag_12", "diff_1", "pct_change_1"])
def t11(spark, sf):
    return TS.lag_features(monthly_revenue(spark, sf), TS_COL, "month", [1, 12])


# -------------------------------------------------------------------- T12
_ACF = (f"WITH m AS ({_M}), d AS (SELECT row_number() {_W} AS i, y - avg(y) OVER () AS d FROM m), "
        "den AS (SELECT sum(d * d) AS den FROM d) "
        "SELECT CAST(k AS BIGINT) AS lag, sum(a.d * b.d) / den AS acf FROM range(1, 25) AS r(k) "
        "CROSS JOIN d AS a JOIN d AS b ON b.i = a.i + k CROSS JOIN den GROUP BY k, den")


@register("t12_acf", _ACF, ["acf"])
def t12(spark, sf):
    return TS.acf(monthly_revenue(spark, sf), TS_COL, "month", 24)


# ------------------------------------------------- many series: T3 to T12 by key
# Daily order value per status, NULL for every 9th order's status, without the
# days whose number in the year divides by 13: many series, one of them with a
# NULL key, all with holes.
def gapped_daily(spark, sf):
    o = read_table(spark, sf, "orders").where(F.dayofyear(TS_COL) % 13 != 0)
    o = o.withColumn("status", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderstatus")))
    return TS.resample(o, TS_COL, "o_totalprice", "day", "sum", by=["status"])


_G = ("WITH d AS (SELECT CASE WHEN o_orderkey % 9 <> 0 THEN o_orderstatus END AS status, "
      "CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS o_orderdate, sum(o_totalprice) AS y FROM orders "
      "WHERE dayofyear(o_orderdate) % 13 <> 0 GROUP BY 1, 2), "
      "b AS (SELECT status, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM d GROUP BY 1), "
      "f AS (SELECT status, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS o_orderdate FROM b), "
      # every calendar step of every series, numbered; y is NULL where the step is missing
      "g AS (SELECT f.status, f.o_orderdate, d.y, d.o_orderdate IS NOT NULL AS present, "
      "row_number() OVER (PARTITION BY f.status ORDER BY f.o_orderdate) - 1 AS idx "
      "FROM f LEFT JOIN d ON f.status IS NOT DISTINCT FROM d.status AND f.o_orderdate = d.o_orderdate) ")
_GW = "(PARTITION BY status ORDER BY o_orderdate)"


@register("t3_fill_gaps_by", _G + "SELECT status, o_orderdate, coalesce(y, 0.0) AS y, NOT present AS filled FROM g", ["y"])
def t3_by(spark, sf):
    return TS.fill_gaps(gapped_daily(spark, sf), TS_COL, "day", "zero", by=["status"])


@register("t4_linear_trend_by", _G + "SELECT status, count(y) AS n, regr_slope(y, CAST(idx AS DOUBLE)) AS slope, "
          "regr_intercept(y, CAST(idx AS DOUBLE)) AS intercept, regr_r2(y, CAST(idx AS DOUBLE)) AS r2 FROM g GROUP BY 1",
          ["slope", "intercept", "r2"], digits=7)
def t4_by(spark, sf):
    return TS.linear_trend(gapped_daily(spark, sf), TS_COL, "day", by=["status"])


_G7 = "OVER (PARTITION BY status ORDER BY o_orderdate ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
_DEC7 = (_G + f", t AS (SELECT *, CASE WHEN count(y) {_G7} = 7 THEN avg(y) {_G7} END AS trend, idx % 7 AS phase FROM g), "
         "raw AS (SELECT status, phase, avg(y - trend) AS s FROM t WHERE present GROUP BY 1, 2), "
         "seas AS (SELECT status, phase, s - avg(s) OVER (PARTITION BY status) AS seasonal FROM raw) ")


@register("t5_decompose_by", _DEC7 + "SELECT t.status, o_orderdate, y, trend, seasonal, y - trend - seasonal AS resid FROM t "
          "LEFT JOIN seas ON t.status IS NOT DISTINCT FROM seas.status AND t.phase = seas.phase WHERE present",
          ["y", "trend", "seasonal", "resid"], digits=6)
def t5_by(spark, sf):
    return TS.decompose(gapped_daily(spark, sf), TS_COL, "day", 7, by=["status"])


_G5 = "OVER (PARTITION BY status ORDER BY o_orderdate ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"


@register("t6_moving_average_by", _G + f"SELECT status, o_orderdate, y, ma FROM (SELECT *, CASE WHEN count(y) {_G5} >= 3 "
          f"THEN avg(y) {_G5} END AS ma FROM g) WHERE present", ["y", "ma"])
def t6_by(spark, sf):
    return TS.moving_average(gapped_daily(spark, sf), TS_COL, "day", 5, min_periods=3, by=["status"])


@register("t7_ewm_by", _G.replace("WITH d", "WITH RECURSIVE d") + ", p AS (SELECT *, row_number() OVER "
          f"{_GW} AS i FROM g WHERE present), r AS (SELECT status, i, o_orderdate, y, y AS ewm FROM p WHERE i = 1 UNION ALL "
          "SELECT p.status, p.i, p.o_orderdate, p.y, 0.2 * p.y + (1.0 - 0.2) * r.ewm FROM p JOIN r "
          "ON p.i = r.i + 1 AND p.status IS NOT DISTINCT FROM r.status) SELECT status, o_orderdate, y, ewm FROM r", ["y", "ewm"])
def t7_by(spark, sf):
    return TS.ewm(gapped_daily(spark, sf), TS_COL, "day", 0.2, by=["status"])


@register("t8_holt_winters_by")
def t8_by(spark, sf):
    return TS.holt_winters(gapped_daily(spark, sf), TS_COL, 7, None, 0.1, 0.1, horizon=14, freq="day", by=["status"])


@register("t8_holt_double_by")
def t8_double(spark, sf):
    return TS.holt_winters(gapped_daily(spark, sf), TS_COL, 1, None, None, horizon=14, freq="day", by=["status"])


@register("t9_forecast_drift_by", _G + ", s AS (SELECT status, max(o_orderdate) AS last, arg_max(y, o_orderdate) AS ly, "
          "arg_min(y, o_orderdate) AS fy, max(idx) - min(idx) AS n FROM g WHERE present GROUP BY 1) "
          "SELECT status, h AS step, last + to_days(CAST(h AS INTEGER)) AS o_orderdate, ly + h * (ly - fy) / nullif(n, 0) AS yhat "
          "FROM s, range(1, 8) AS r(h)", ["yhat"])
def t9_drift_by(spark, sf):
    return TS.forecast(gapped_daily(spark, sf), TS_COL, 7, "drift", "day", by=["status"])


@register("t9_forecast_seasonal_naive_by", _G + ", s AS (SELECT status, max(o_orderdate) AS last, max(idx) AS n FROM g WHERE present GROUP BY 1) "
          "SELECT s.status, h AS step, last + to_days(CAST(h AS INTEGER)) AS o_orderdate, g.y AS yhat FROM s CROSS JOIN range(1, 15) AS r(h) "
          "LEFT JOIN g ON g.status IS NOT DISTINCT FROM s.status AND g.idx = s.n - 6 + (h - 1) % 7", ["yhat"])
def t9_snaive_by(spark, sf):
    return TS.forecast(gapped_daily(spark, sf), TS_COL, 14, "seasonal_naive", "day", period=7, by=["status"])


@register("t9_forecast_trend_season_by", _DEC7 + ", tr AS (SELECT status, max(o_orderdate) AS last, max(idx) AS n, "
          "regr_slope(trend, CAST(idx AS DOUBLE)) AS slope, regr_intercept(trend, CAST(idx AS DOUBLE)) AS intercept FROM t WHERE present GROUP BY 1) "
          "SELECT tr.status, h AS step, last + to_days(CAST(h AS INTEGER)) AS o_orderdate, intercept + slope * (n + h) + seasonal AS yhat "
          "FROM tr CROSS JOIN range(1, 15) AS r(h) LEFT JOIN seas ON seas.status IS NOT DISTINCT FROM tr.status AND seas.phase = (n + h) % 7",
          ["yhat"], digits=6)
def t9_ts_by(spark, sf):
    return TS.forecast(gapped_daily(spark, sf), TS_COL, 14, "trend_season", "day", period=7, by=["status"])


@register("t9_forecast_ar_by")
def t9_ar_by(spark, sf):
    return TS.forecast(gapped_daily(spark, sf), TS_COL, 7, "ar", "day", p=2, by=["status"])


@register("t10_backtest_by", _G + ", s AS (SELECT status, max(idx) AS n FROM g WHERE present GROUP BY 1), "
          "tr AS (SELECT g.status, g.idx, g.y FROM g JOIN s ON g.status IS NOT DISTINCT FROM s.status WHERE present AND s.n - g.idx >= 7), "
          "l AS (SELECT status, arg_max(y, idx) AS yhat, max(idx) AS last FROM tr GROUP BY 1), "
          "j AS (SELECT g.status, g.y AS a, CASE WHEN g.idx - l.last <= 7 THEN l.yhat END AS p FROM g JOIN s ON g.status IS NOT DISTINCT FROM s.status "
          "LEFT JOIN l ON g.status IS NOT DISTINCT FROM l.status WHERE present AND s.n - g.idx < 7) "
          "SELECT status, count(a - p) AS n, avg(abs(a - p)) AS mae, sqrt(avg((a - p) * (a - p))) AS rmse, "
          "avg(CASE WHEN a <> 0 THEN abs((a - p) / a) END) AS mape FROM j GROUP BY 1", ["mae", "rmse", "mape"])
def t10_by(spark, sf):
    return TS.backtest(gapped_daily(spark, sf), TS_COL, 7, "naive", "day", by=["status"])


@register("t11_lag_features_by", _G + f"SELECT status, o_orderdate, y, lag_1, lag_7, y - lag_1 AS diff_1, CASE WHEN lag_1 <> 0 THEN "
          f"(y - lag_1) / lag_1 END AS pct_change_1 FROM (SELECT *, lag(y, 1) OVER {_GW} AS lag_1, lag(y, 7) OVER {_GW} AS lag_7 FROM g) "
          "WHERE present", ["y", "lag_1", "lag_7", "diff_1", "pct_change_1"])
def t11_by(spark, sf):
    return TS.lag_features(gapped_daily(spark, sf), TS_COL, "day", [1, 7], by=["status"])


@register("t12_acf_by", _G + ", m AS (SELECT status, idx, y - avg(y) OVER (PARTITION BY status) AS d FROM g), "
          "den AS (SELECT status, sum(d * d) AS den FROM m GROUP BY 1) "
          "SELECT a.status, CAST(k AS BIGINT) AS lag, sum(a.d * b.d) / nullif(den, 0) AS acf FROM range(1, 8) AS r(k) CROSS JOIN m AS a "
          "LEFT JOIN m AS b ON b.idx = a.idx + k AND a.status IS NOT DISTINCT FROM b.status "
          "JOIN den ON den.status IS NOT DISTINCT FROM a.status GROUP BY a.status, k, den", ["acf"], digits=7)
def t12_by(spark, sf):
    return TS.acf(gapped_daily(spark, sf), TS_COL, "day", 7, by=["status"])


# ------------------------------------------- sparse series: days between orders
# Daily order value per customer: thousands of series of about ten values each, weeks or
# months apart, so nothing but the calendar tells how many steps lie between two rows.
def sparse_daily(spark, sf):
    return TS.resample(read_table(spark, sf, "orders"), TS_COL, "o_totalprice", "day", "sum", by=["o_custkey"])


_S = ("WITH g AS (SELECT o_custkey, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS o_orderdate, sum(o_totalprice) AS y "
      "FROM orders GROUP BY 1, 2), "
      "i AS (SELECT *, date_diff('day', min(o_orderdate) OVER (PARTITION BY o_custkey), o_orderdate) AS idx FROM g) ")


@register("t4_linear_trend_sparse", _S + "SELECT o_custkey, count(y) AS n, regr_slope(y, CAST(idx AS DOUBLE)) AS slope, "
          "regr_intercept(y, CAST(idx AS DOUBLE)) AS intercept, CASE WHEN count(*) > 1 THEN regr_r2(y, CAST(idx AS DOUBLE)) END AS r2 "
          "FROM i GROUP BY 1", ["slope", "intercept", "r2"], digits=6)
def t4_sparse(spark, sf):
    return TS.linear_trend(sparse_daily(spark, sf), TS_COL, "day", by=["o_custkey"])


_S90 = "OVER (PARTITION BY o_custkey ORDER BY idx RANGE BETWEEN 89 PRECEDING AND CURRENT ROW)"


@register("t6_moving_average_sparse", _S + f"SELECT o_custkey, o_orderdate, y, CASE WHEN count(y) {_S90} >= 2 THEN avg(y) {_S90} END AS ma FROM i",
          ["y", "ma"])
def t6_sparse(spark, sf):
    return TS.moving_average(sparse_daily(spark, sf), TS_COL, "day", 90, min_periods=2, by=["o_custkey"])


@register("t9_forecast_drift_sparse", _S + ", s AS (SELECT o_custkey, max(o_orderdate) AS last, arg_max(y, idx) AS ly, arg_min(y, idx) AS fy, "
          "max(idx) AS n FROM i GROUP BY 1) SELECT o_custkey, h AS step, last + to_days(CAST(h AS INTEGER)) AS o_orderdate, "
          "ly + h * (ly - fy) / nullif(n, 0) AS yhat FROM s, range(1, 3) AS r(h)", ["yhat"])
def t9_drift_sparse(spark, sf):
    return TS.forecast(sparse_daily(spark, sf), TS_COL, 2, "drift", "day", by=["o_custkey"])


@register("t10_backtest_sparse", _S + ", e AS (SELECT *, max(idx) OVER (PARTITION BY o_custkey) - idx AS rest FROM i), "
          "l AS (SELECT o_custkey, arg_max(y, idx) AS yhat, max(idx) AS last FROM e WHERE rest >= 365 GROUP BY 1), "
          "j AS (SELECT e.o_custkey, e.y AS a, CASE WHEN e.idx - l.last <= 365 THEN l.yhat END AS p FROM e "
          "LEFT JOIN l USING (o_custkey) WHERE rest < 365) "
          "SELECT o_custkey, count(a - p) AS n, avg(abs(a - p)) AS mae, sqrt(avg((a - p) * (a - p))) AS rmse, "
          "avg(CASE WHEN a <> 0 THEN abs((a - p) / a) END) AS mape FROM j GROUP BY 1", ["mae", "rmse", "mape"], digits=7)
def t10_sparse(spark, sf):
    return TS.backtest(sparse_daily(spark, sf), TS_COL, 365, "naive", "day", by=["o_custkey"])


@register("t11_lag_features_sparse", _S + "SELECT a.o_custkey, a.o_orderdate, a.y, b.y AS lag_1, c.y AS lag_7, a.y - b.y AS diff_1, "
          "CASE WHEN b.y <> 0 THEN (a.y - b.y) / b.y END AS pct_change_1 FROM i AS a "
          "LEFT JOIN i AS b ON b.o_custkey = a.o_custkey AND b.idx = a.idx - 1 "
          "LEFT JOIN i AS c ON c.o_custkey = a.o_custkey AND c.idx = a.idx - 7", ["y", "lag_1", "lag_7", "diff_1", "pct_change_1"])
def t11_sparse(spark, sf):
    return TS.lag_features(sparse_daily(spark, sf), TS_COL, "day", [1, 7], by=["o_custkey"])


# ------------------------------------------------------------------- T9 ARIMA
_ARI = (f"WITH RECURSIVE m AS ({_M}), g AS (SELECT o_orderdate, y, y - lag(y) {_W} AS w, row_number() {_W} AS i FROM m), "
        "f AS (SELECT regr_slope(g.w, p.w) AS phi, regr_intercept(g.w, p.w) AS c FROM g JOIN g AS p ON p.i = g.i - 1 AND p.w IS NOT NULL), "
        "r AS (SELECT CAST(0 AS BIGINT) AS step, max(o_orderdate) AS last, arg_max(y, i) AS yhat, arg_max(w, i) AS w FROM g UNION ALL "
        "SELECT step + 1, last, yhat + c + phi * w, c + phi * w FROM r, f WHERE step < 12) ")


@register("t9_forecast_arima_110", _ARI + "SELECT step, last + to_months(CAST(step AS INTEGER)) AS o_orderdate, yhat, "
          "CAST(NULL AS VARCHAR) AS reason FROM r WHERE step > 0", ["yhat"], digits=7)
def t9_arima_110(spark, sf):
    return AR.forecast_arima(monthly_revenue(spark, sf), TS_COL, "month", 12, (1, 1, 0))


@register("t9_arima_by")
def t9_arima_by(spark, sf):
    return AR.arima(gapped_daily(spark, sf), TS_COL, "day", (1, 0, 1), by=["status"])


@register("t9_forecast_arima_chosen")
def t9_arima_chosen(spark, sf):
    return AR.choose_arima(monthly_revenue(spark, sf), TS_COL, "month", 12, [(0, 1, 0), (1, 1, 0), (0, 1, 1), (1, 1, 1)])


# ------------------------------------------------------------- T1 streaming
@register("t1_resample_stream", "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, avg(value) AS y "
                                "FROM events GROUP BY 1", ["y"])
def t1_stream(spark, sf):
    """The hourly resample as a Structured Streaming query over the events
    table read as a file stream, run until all input is processed."""
    from tally.streaming import resample_stream, run_to_table, stream_table
    res = resample_stream(stream_table(spark, sf, "events"), "ts", "value", "hour", "avg")
    return spark.read.parquet(run_to_table(spark, res, "events-hourly"))
