"""Time series (T1-T12).

Step 0 is always :func:`resample` (a grouped aggregate with partial
aggregation), so every later window runs on a regular grid — one row per
series and time step — never on raw rows.  Windows are partitioned by the
series key: a single series of N steps is one task holding N rows, bounded by
its time range and frequency, not by the data volume.

Steps and phases come from the calendar, not from row numbers: a missing step
leaves a hole in a frame, it does not shift what follows.  A NULL series key is
a series of its own.

Recursions (exponential smoothing, Holt-Winters, AR) are affine in their state,
so they run as scans over ranges of a series (``functions.scan``): a series of
any length is spread over tasks, and a single series is no special case.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.functions.scan import Scan, ranges
from tally.functions.stats import as_col, join_on_keys, nan_to_null
from tally.operators.charts import agg_expr, slot_expr, time_key
from tally.session import ship_package, written

_UNITS = {"hour": ("HOUR", 1), "day": ("DAY", 1), "week": ("DAY", 7), "month": ("MONTH", 1),
          "quarter": ("MONTH", 3), "year": ("MONTH", 12)}


def _step(freq: str) -> tuple[str, int]:
    if freq not in _UNITS:
        raise ValueError(f"unsupported frequency {freq!r}")
    return _UNITS[freq]


def shift_time(ts: Column, steps: Column, freq: str) -> Column:
    """``ts`` moved by ``steps`` grid steps of ``freq``."""
    unit, mult = _step(freq)
    return F.timestamp_add(unit, steps * mult, ts)


def _w(by: Sequence[str], ts: str) -> Window:
    return Window.partitionBy(*by).orderBy(F.col(ts))


# --------------------------------------------------------------------- T1
def resample(df: DataFrame, ts: str, y: str | None, freq: str, agg: str = "sum",
             by: Sequence[str] = ()) -> DataFrame:
    """Aggregate raw rows onto a time grid: ``(by..., ts, y)``."""
    return df.groupBy(*by, time_key(df, ts, freq).alias(ts)).agg(agg_expr(agg, y).cast("double").alias("y"))


# --------------------------------------------------------------------- T2
def slot_profile(df: DataFrame, ts: str, y: str | None, slot: str = "hour", agg: str = "avg") -> DataFrame:
    """Pattern by hour of day / ISO weekday / day of month / month."""
    return df.groupBy(slot_expr(as_col(ts), slot).alias("slot")).agg(
        agg_expr(agg, y).cast("double").alias("y"), F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------- T3
def fill_gaps(grid: DataFrame, ts: str, freq: str, how: str = "null", y: str = "y",
              by: Sequence[str] = ()) -> DataFrame:
    """Insert the missing steps between each series' first and last step.
    how: "null" leaves them NULL, "zero" fills 0, "ffill" carries the last
    value forward.  Adds ``filled`` (true for inserted steps)."""
    by = list(by)
    unit, mult = _step(freq)
    interval = F.expr(f"INTERVAL {mult} {unit}")
    bounds = grid.groupBy(*by).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    full = bounds.select(*by, F.explode(F.sequence("_lo", "_hi", interval)).alias(ts))
    j = join_on_keys(full, grid.withColumn("_present", F.lit(True)), [*by, ts], "left")
    if how == "null":
        val = F.col(y)
    elif how == "zero":
        val = F.coalesce(F.col(y), F.lit(0.0))
    elif how == "ffill":
        val = F.last(F.col(y), ignorenulls=True).over(
            _w(by, ts).rowsBetween(Window.unboundedPreceding, 0))
    else:
        raise ValueError(f"unknown fill {how!r}")
    rest = [c for c in grid.columns if c not in (*by, ts, y)]
    return j.select(*by, ts, val.alias(y), *rest, F.col("_present").isNull().alias("filled"))


# --------------------------------------------------------------------- T4
def step_number(ts: str, freq: str) -> Column:
    """The number of the calendar step of ``freq`` that holds a time stamp."""
    _step(freq)
    t = as_col(ts).cast("timestamp_ntz")
    months = F.year(t) * 12 + F.month(t) - 1
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = F.timestamp_diff("SECOND", epoch, F.date_trunc("HOUR", t))
    days = F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date"))
    n = {"hour": F.floor(seconds / 3600), "day": days, "week": F.floor((days + 3) / 7), "month": months,
         "quarter": F.floor(months / 3), "year": F.year(t)}[freq]  # weeks begin on Monday: day -3
    return n.cast("long")


def with_index(grid: DataFrame, ts: str, freq: str, by: Sequence[str] = ()) -> DataFrame:
    """0-based step number ``idx`` within each series: how many steps of
    ``freq`` the calendar has from the series' first step.  Missing steps leave
    their numbers out, however sparse the series is."""
    g = grid.withColumn("_at", step_number(ts, freq))
    first = g.groupBy(*by).agg(F.min("_at").alias("_at0"))
    j = join_on_keys(g, first, list(by)) if by else g.crossJoin(first)  # one row
    return j.withColumn("idx", F.col("_at") - F.col("_at0")).drop("_at", "_at0")


def _iw(by: Sequence[str]) -> Window:
    """Window over step numbers: RANGE frames count steps, not rows."""
    return Window.partitionBy(*by).orderBy("idx")


def _at_step(y: Column, w: Window, k: int) -> Column:
    """The value ``k`` steps away (NULL where that step is missing)."""
    return F.max(y).over(w.rangeBetween(k, k))


def linear_trend(grid: DataFrame, ts: str, freq: str, y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line through the grid: slope per step, intercept at the
    first step, R^2."""
    g = with_index(grid, ts, freq, by)
    x, v = F.col("idx").cast("double"), nan_to_null(y)
    return g.groupBy(*by).agg(F.count(v).alias("n"), F.regr_slope(v, x).alias("slope"),
                              F.regr_intercept(v, x).alias("intercept"), F.regr_r2(v, x).alias("r2"))


# --------------------------------------------------------------------- T5
def centered_ma(y: Column, w: Window, period: int) -> Column:
    """Centred moving average of length ``period`` (2 x period for even
    periods) over a window of step numbers, NULL where the frame is not full."""
    if period % 2 == 0:
        h = period // 2
        frame = w.rangeBetween(-h, h)
        full = F.sum(y).over(frame) - 0.5 * (_at_step(y, w, -h) + _at_step(y, w, h))
        return F.when(F.count(y).over(frame) == period + 1, full / period)
    h = (period - 1) // 2
    frame = w.rangeBetween(-h, h)
    return F.when(F.count(y).over(frame) == period, F.avg(y).over(frame))


def decompose(grid: DataFrame, ts: str, freq: str, period: int, model: str = "additive", y: str = "y",
              by: Sequence[str] = ()) -> DataFrame:
    """Classical decomposition into trend (centred moving average), seasonal
    (mean detrended value per phase, centred to 0 or to mean 1) and residual.
    Phase = step number mod period, counted from each series' first step by
    the calendar.  Where a step is missing, the frames over it have no trend."""
    return _decompose(grid, ts, freq, period, model, y, by).select(*by, ts, "y", "trend", "seasonal", "resid")


def _decompose(grid: DataFrame, ts: str, freq: str, period: int, model: str, y: str, by: Sequence[str]) -> DataFrame:
    by = list(by)
    if model not in ("additive", "multiplicative"):
        raise ValueError(f"unknown model {model!r}")
    g = with_index(grid.select(*by, ts, nan_to_null(y).alias("y")), ts, freq, by)
    g = g.withColumn("trend", centered_ma(F.col("y"), _iw(by), period)).withColumn("phase", F.col("idx") % period)
    # multiplicative parts use try_divide: a zero trend or index gives NULL, not an error
    detr = F.col("y") - F.col("trend") if model == "additive" else F.try_divide(F.col("y"), F.col("trend"))
    raw = g.groupBy(*by, "phase").agg(F.avg(detr).alias("_s"))
    norm = raw.groupBy(*by).agg(F.avg("_s").alias("_m"))
    seas = join_on_keys(raw, norm, by) if by else raw.crossJoin(norm)
    seas = seas.select(*by, "phase", (F.col("_s") - F.col("_m") if model == "additive"
                                      else F.try_divide(F.col("_s"), F.col("_m"))).alias("seasonal"))
    # one row per (series, phase): small next to the grid
    out = join_on_keys(g, seas, [*by, "phase"], "left")
    resid = (F.col("y") - F.col("trend") - F.col("seasonal") if model == "additive"
             else F.try_divide(F.col("y"), F.col("trend") * F.col("seasonal")))
    return out.withColumn("resid", resid)


# --------------------------------------------------------------------- T6
def moving_average(grid: DataFrame, ts: str, freq: str, window: int, min_periods: int | None = None,
                   y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Trailing moving average over ``window`` steps of the calendar; NULL
    until ``min_periods`` (default: window) values are in the frame."""
    v, frame = nan_to_null(y), _iw(by).rangeBetween(-(window - 1), 0)
    mp = window if min_periods is None else min_periods
    return with_index(grid, ts, freq, by).withColumn(
        "ma", F.when(F.count(v).over(frame) >= mp, F.avg(v).over(frame))).drop("idx")


# ------------------------------------------------------------------ T7 T8
def _keyed(grid: DataFrame, ts: str, freq: str, y: str, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``_k0.., idx, ts, y`` and the names of the keys (the series may have columns of any name)."""
    key = [f"_k{i}" for i in range(len(by))]
    g = with_index(grid.select(*[as_col(b).alias(k) for b, k in zip(by, key)], as_col(ts).alias("ts"),
                               nan_to_null(y).alias("y")), "ts", freq, key)
    return g, key


def _named(df: DataFrame, key: Sequence[str], by: Sequence[str], rest: Sequence[Column]) -> DataFrame:
    return df.select(*[F.col(k).alias(b) for k, b in zip(key, by)], *rest)


def _per_series(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    return join_on_keys(a, b, key, "left") if key else a.crossJoin(b)  # without keys: one row a side


def _dense(g: DataFrame, lengths: DataFrame, key: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    """``key, idx, y`` (and ``more`` of ``lengths``) for every step from 0 to ``n - 1``; missing ones have a NULL value."""
    every = lengths.select(*key, *more, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("idx"))
    return join_on_keys(every, g.select(*key, "idx", "y"), [*key, "idx"], "left")


def ewm(grid: DataFrame, ts: str, freq: str, alpha: float, y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Simple exponential smoothing s_1 = y_1, s_t = a y_t + (1 - a) s_(t-1), over the
    rows of the grid (NULL and missing steps carry the state; before the first
    value there is none)."""
    g, key = _keyed(grid, ts, freq, y, by)
    known = F.when(F.col("y").isNotNull(), F.col("idx"))
    start = g.groupBy(*key).agg((F.max("idx") + 1).alias("n"), F.min(known).alias("begin"), F.min_by("y", known).alias("y0"))
    state = start.select(*key, F.lit(0).alias("variant"), F.array(F.coalesce("y0", F.lit(0.0))).alias("state"), F.struct("begin").alias("p"))
    a, b = float(alpha), 1.0 - float(alpha)

    def step(s: Column, x: Column, p: Column, inputs: bool) -> Column:
        v = x.cell.y if inputs else F.lit(0.0)
        return F.when(x.cell.y.isNotNull() & (x.idx > p.begin), F.array(a * v + b * s[0])).otherwise(s)

    def emit(_: Column, x: Column, s: Column, p: Column) -> Column:
        return F.struct(x.cell.alias("cell"), F.when(x.idx >= p.begin, s[0]).alias("ewm"))

    cells = g.select(*key, "idx", F.struct("ts", "y").alias("cell"))
    out = Scan(ranges(cells, start.select(*key, "n"), key), state, key, 1, step).steps(emit)
    return _named(out, key, by, [F.col("out.cell.ts").alias(ts), F.col("out.cell.y").alias("y"), F.col("out.ewm").alias("ewm")])


_SEARCH = [i / 10 for i in range(1, 10)]


def _smoothing_start(g: DataFrame, key: list[str], period: int) -> DataFrame:
    """``key, n, begin, state, reason``: level, trend and the coming season's indices before step
    ``begin``; a NULL ``begin`` for a series that is too short, and why."""
    known = F.when(F.col("y").isNotNull(), F.col("idx"))
    if period == 1:
        first = g.groupBy(*key).agg(F.max("idx").alias("last"), F.min(known).alias("i"), F.min_by("y", known).alias("yi"))
        later = F.when(F.col("idx") > F.col("i"), known)
        second = _per_series(g, first, key).groupBy(*key).agg(F.min(later).alias("j"), F.min_by("y", later).alias("yj"))
        s = _per_series(first, second, key)
        state = F.array("yj", (F.col("yj") - F.col("yi")) / (F.col("j") - F.col("i")), F.lit(0.0))
        begin, enough, why = F.col("j") + 1, F.col("j").isNotNull(), "fewer than two values"
    else:
        # state at the end of the first season: its mean sits at its middle, so it is shifted by
        # the initial trend; the indices come from the detrended first season
        seasons = [F.when(F.col("idx").between(i * period, (i + 1) * period - 1), F.col("y")) for i in (0, 1)]
        s = g.groupBy(*key).agg(
            F.max("idx").alias("last"), F.avg(seasons[0]).alias("m0"), F.avg(seasons[1]).alias("m1"),
            F.collect_list(F.when(F.col("idx") < period, F.struct("idx", "y"))).alias("season"))
        s = s.withColumn("b0", (F.col("m1") - F.col("m0")) / period)
        mid = (period - 1) / 2.0
        line = F.col("m0") + F.col("b0") * F.lit(-mid)
        index = F.transform(F.sequence(F.lit(0), F.lit(period - 1)), lambda k: F.coalesce(
            F.get(F.filter("season", lambda c: c.idx == k), F.lit(0)).y - (line + F.col("b0") * k), F.lit(0.0)))
        state = F.concat(F.array(F.col("m0") + F.col("b0") * mid, F.col("b0")), index)
        begin = F.lit(period).cast("long")
        enough = (F.col("last") + 1 >= 2 * period) & F.col("b0").isNotNull()
        why = f"fewer than two seasons of {period} steps"
    width = period + 2
    return s.select(*key, (F.col("last") + 1).alias("n"), F.when(enough, begin).alias("begin"),
                    F.when(enough, state).otherwise(F.array(*[F.lit(0.0)] * width)).alias("state"),
                    F.when(~enough, F.lit(why)).alias("reason"))


def _error(s: Column, x: Column, inputs: bool = True) -> Column:
    """Value less one-step fit; 0 for a missing step, which so moves along the trend."""
    v = x.cell.y if inputs else F.lit(0.0)
    return F.when(x.cell.y.isNotNull(), v - s[0] - s[1] - s[2]).otherwise(0.0)


def _smoothing_step(period: int):
    """One step of additive smoothing on (level, trend, indices of the coming steps in turn), in its
    error-correction form: with the one-step error e, level += trend + a e, trend += a b e,
    index += g (1 - a) e."""
    def step(s: Column, x: Column, p: Column, inputs: bool) -> Column:
        e = _error(s, x, inputs)
        moved = F.array(s[0] + s[1] + p.a * e, s[1] + p.ab * e)
        if period == 1:
            return F.concat(moved, F.slice(s, 3, 1))  # no season: its index stays 0
        return F.concat(moved, F.slice(s, 4, period - 1), F.array(s[2] + p.ga * e))
    return step


def _smoothing(g: DataFrame, key: list[str], period: int, alpha, beta, gamma) -> tuple[Scan, DataFrame, DataFrame]:
    """The scan with the parameters given or found, ``key, n, begin, reason``, and the steps before the scan."""
    start = _smoothing_start(g, key, period)
    gamma = 0.0 if period == 1 else gamma
    choices = list(product(*[_SEARCH if v is None else [float(v)] for v in (alpha, beta, gamma)]))
    tried = F.array(*[F.struct(F.lit(i).alias("variant"), F.lit(a).alias("a"), F.lit(a * b).alias("ab"), F.lit(c * (1 - a)).alias("ga"))
                      for i, (a, b, c) in enumerate(choices)])
    variants = start.select("*", F.explode(tried).alias("_v")).select(
        *key, F.col("_v.variant").alias("variant"), "state", F.struct("begin", "_v.a", "_v.ab", "_v.ga").alias("p"))
    every = _dense(g, start, key, ["n", "begin"])
    steps = ranges(every.where(F.col("idx") >= F.col("begin")).select(*key, "idx", F.struct("y").alias("cell")),
                   start.select(*key, "n"), key)
    if len(choices) > 1:
        steps, variants = written(steps, "smoothing-steps"), written(variants, "smoothing-variants")
        errors = Scan(steps, variants, key, period + 2, _smoothing_step(period), many=True).steps(lambda s, x, _, p: _error(s, x))
        errors = errors.groupBy(*key, "variant").agg(F.sum(F.col("out") * F.col("out")).alias("_e"))
        best = errors.groupBy(*key).agg(F.min_by("variant", F.struct("_e", "variant")).alias("variant"))
        best = join_on_keys(start.select(*key), best, key, "left") if key else start.select(F.lit(1).alias("_")).join(best, how="left").drop("_")
        best = best.select(*key, F.coalesce("variant", F.lit(0)).alias("variant"), F.lit(True).alias("_best"))
        variants = join_on_keys(variants, best, [*key, "variant"]).drop("_best")
    early = every.where(F.col("begin").isNull() | (F.col("idx") < F.col("begin"))).select(*key, "idx", "y")
    return Scan(steps, variants, key, period + 2, _smoothing_step(period)), start, early


def holt_winters(grid: DataFrame, ts: str, period: int, alpha: float | None = 0.3, beta: float | None = 0.1,
                 gamma: float | None = 0.2, horizon: int = 0, freq: str = "month", y: str = "y",
                 by: Sequence[str] = ()) -> DataFrame:
    """Additive Holt-Winters (level, trend, season) per series; ``period`` 1 is
    Holt's double smoothing (level, trend).  Returns the in-sample one-step
    fits (step <= 0, step 0 = last observed) and ``horizon`` forecasts
    (step > 0) with their time stamps.

    A parameter given as None is searched (0.1 to 0.9) for the least squared
    error of the one-step fits, per series: every combination is a variant
    of the series in one scan.  Missing steps and NULL values
    move along the trend.  A series that is too short has NULL fits and says
    why in ``reason``.  A series may be of any length: its steps are scanned
    in ranges (``functions.scan``)."""
    g, key = _keyed(grid, ts, freq, y, by)
    scan, start, early = _smoothing(g, key, period, alpha, beta, gamma)
    fits = scan.steps(lambda s, x, _, p: F.struct(x.idx.alias("idx"), x.cell.y.alias("y"), (s[0] + s[1] + s[2]).alias("fitted")))
    fits = fits.select(*key, "out.*").unionByName(early.withColumn("fitted", F.lit(None).cast("double")))
    last = g.groupBy(*key).agg(F.max("ts").alias("_last"))
    ends = _per_series(start.select(*key, "n", "begin", "reason"), last, key)
    rows = _per_series(fits, ends, key).select(*key, (F.col("idx") - F.col("n") + 1).alias("step"), "_last", "y", "fitted", "reason")
    if horizon > 0:
        h = F.col("step")
        steps = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(horizon).cast("long"))).alias("step")
        index = F.get("state", (2 + (h - 1) % period).cast("int"))
        ahead = F.when(F.col("begin").isNotNull(), F.col("state")[0] + h * F.col("state")[1] + index)
        rows = rows.unionByName(_per_series(scan.final.select(*key, "state"), ends, key).select("*", steps).select(
            *key, "step", "_last", F.lit(None).cast("double").alias("y"), ahead.alias("fitted"), "reason"))
    return _named(rows, key, by, [F.col("step"), shift_time(F.col("_last"), F.col("step"), freq).alias(ts), F.col("y"),
                                  nan_to_null("fitted").alias("fitted"), F.col("reason")])


# ------------------------------------------------------------------ T9 T10
def lagged(g: DataFrame, key: Sequence[str], value: str, lags: int) -> DataFrame:
    """``key, idx, v`` for every step whose value and ``lags`` values before it are known: ``v`` is
    the value and those before it, the nearest first.  Every value is dealt to the steps it serves,
    so no window walks a series."""
    served = g.where(F.col(value).isNotNull()).select(*key, F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(lags)), lambda k: F.struct((F.col("idx") + k).alias("idx"), k.alias("k"),
                                                              F.col(value).alias("v")))).alias("_s"))
    v = F.array(*[F.max(F.when(F.col("_s.k") == k, F.col("_s.v"))) for k in range(lags + 1)])
    rows = served.groupBy(*key, F.col("_s.idx").alias("idx")).agg(v.alias("v"))
    return rows.where(~F.exists("v", lambda x: x.isNull()))


def cross_moments(rows: DataFrame, key: Sequence[str], vector: Column, k: int) -> DataFrame:
    """``key, m, gram``: number of rows and the sums of all products of (1, vector) as k + 1 rows, in one aggregate."""
    one = rows.select(*key, F.concat(F.array(F.lit(1.0)), vector).alias("_v"))
    sums = [F.sum(F.col("_v")[i] * F.col("_v")[j]).alias(f"_g{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]
    gram = F.array(*[F.array(*[F.col(f"_g{min(i, j)}_{max(i, j)}") for j in range(k + 1)]) for i in range(k + 1)])
    return one.groupBy(*key).agg(F.count(F.lit(1)).alias("m"), *sums).select(*key, "m", gram.alias("gram"))


def least_squares(gram: np.ndarray, target: int) -> np.ndarray:
    """Coefficients of the other columns of a Gram matrix for column ``target`` (least norm if they
    are dependent), from columns scaled to length one."""
    rest = [i for i in range(len(gram)) if i != target]
    a, b = gram[np.ix_(rest, rest)], gram[rest, target]
    scale = np.sqrt(np.diag(a))
    scale[scale == 0] = 1.0
    return np.linalg.lstsq(a / np.outer(scale, scale), b / scale, rcond=1e-13)[0] / scale


def _solved(gram: Column) -> Column:
    """Coefficients for the last column of a Gram matrix, a small system per series."""
    @F.pandas_udf("array<double>")
    def solve(grams: pd.Series) -> pd.Series:
        return pd.Series([None if g is None else least_squares(np.vstack(g), len(g) - 1).tolist() for g in grams])
    return solve(gram)


def _ar(g: DataFrame, key: list[str], p: int, horizon: int) -> DataFrame:
    """``key, step, yhat, reason``: AR(p) by least squares from lagged cross moments about the mean."""
    ship_package(g.sparkSession)
    mean = g.groupBy(*key).agg(F.avg("y").alias("_mean"), F.max("idx").alias("_end"))
    z = _per_series(g, mean, key).withColumn("z", F.col("y") - F.col("_mean"))
    rows = lagged(z, key, "z", p)
    order = F.concat(F.slice("v", 2, p), F.slice("v", 1, 1))  # lags first, the value last
    fit = cross_moments(rows, key, order, p + 1)
    fit = fit.select(*key, "m", F.when(F.col("m") > p + 1, F.col("gram")).alias("gram")).withColumn("coef", _solved(F.col("gram")))
    length = mean.select(*key, (F.col("_end") + 1).alias("n"))
    start = _per_series(mean, fit.select(*key, "m", "coef"), key) if key else mean.join(fit.select("m", "coef"), how="left")
    start = start.select(*key, F.lit(0).alias("variant"), F.array(*[F.lit(0.0)] * p).alias("state"), F.struct("coef", "_mean", "m").alias("p"))

    def step(s: Column, x: Column, par: Column, inputs: bool) -> Column:
        # a missing step takes its own prediction; before the first step there is the mean
        guess = F.aggregate(F.zip_with(F.slice(par.coef, 2, p), s, lambda c, v: c * v),
                            par.coef[0] if inputs else F.lit(0.0), lambda acc, v: acc + v)
        seen = x.cell.z if inputs else F.lit(0.0)
        return F.concat(F.array(F.when(x.cell.z.isNotNull(), seen).otherwise(guess)), F.slice(s, 1, p - 1))

    every = _dense(z.select(*key, "idx", F.col("z").alias("y")), length, key)
    cells = every.select(*key, "idx", F.struct(F.col("y").alias("z")).alias("cell"))
    last = Scan(ranges(cells, length, key), start, key, p, step).final
    nothing = F.struct(F.lit(None).cast("double").alias("z"))
    ahead = F.aggregate(
        F.sequence(F.lit(1), F.lit(horizon)), F.struct(F.array().cast("array<double>").alias("out"), F.col("state").alias("s")),
        lambda acc, h: (lambda nxt: F.struct(F.concat(acc.out, F.slice(nxt, 1, 1)).alias("out"), nxt.alias("s")))(
            step(acc.s, F.struct(nothing.alias("cell")), F.col("p"), True)))
    return last.select(*key, "p", F.posexplode(ahead.out).alias("_h", "_z")).select(
        *key, (F.col("_h") + 1).cast("long").alias("step"), (F.col("_z") + F.col("p._mean")).alias("yhat"),
        F.when(F.coalesce("p.m", F.lit(0)) <= p + 1, F.lit(f"too few steps for {p} lags")).alias("reason"))


def _future(last: DataFrame, ts: str, horizon: int, freq: str, by: Sequence[str], at: DataFrame | None) -> DataFrame:
    """``last`` (a row per series, ``_last``: the time of its last step) with every ``step`` from 1 to
    ``horizon`` and its time ``ts``; given ``at`` (``by..., ts``, distinct), with the steps at those times only."""
    if at is None:
        steps = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(horizon).cast("long"))).alias("step")
        return last.select("*", steps).withColumn(ts, shift_time(F.col("_last"), F.col("step"), freq))
    wanted = join_on_keys(at, last, by) if by else at.crossJoin(F.broadcast(last))  # one row
    # clock changes move a step's number by one at most
    near = step_number(ts, freq) - step_number("_last", freq)
    near = wanted.withColumn("step", F.explode(F.array(near - 1, near, near + 1)))
    return near.where(F.col("step").between(1, horizon) & (F.col(ts) == shift_time(F.col("_last"), F.col("step"), freq)))


def forecast(grid: DataFrame, ts: str, horizon: int, method: str = "naive", freq: str = "month",
             period: int | None = None, y: str = "y", by: Sequence[str] = (), p: int = 2,
             at: DataFrame | None = None, **hw) -> DataFrame:
    """``horizon`` future steps per series: ``(by..., step, ts, yhat)``.

    naive: last value.  seasonal_naive: value one season back (NULL where
    that step is missing).  drift: last value plus the average change per
    step.  mean: series mean.  trend_season: line through the decomposition
    trend plus the additive seasonal index.  holt_winters: additive HW.  ar:
    AR(p) least squares per series.  The last two also give ``reason``, which
    says why a series has NULL forecasts.  Steps follow the calendar; a
    series' forecasts start after its last step.  ``at`` (``by..., ts``, distinct)
    asks for the steps at those times only; holt_winters and ar give all of them.
    """
    by = list(by)
    g = grid.select(*by, ts, nan_to_null(y).alias("y"))
    if method == "holt_winters":
        hwf = holt_winters(g, ts, period or 12, horizon=horizon, freq=freq, by=by, **hw)
        return hwf.where(F.col("step") > 0).select(*by, "step", ts, F.col("fitted").alias("yhat"), "reason")
    if method == "ar":
        gk, key = _keyed(g, ts, freq, "y", by)
        last = gk.groupBy(*key).agg(F.max("ts").alias("_last"))
        out = _per_series(_ar(gk, key, p, horizon), last, key)
        return _named(out, key, by, [F.col("step"), shift_time(F.col("_last"), F.col("step"), freq).alias(ts),
                                     nan_to_null("yhat").alias("yhat"), F.col("reason")])
    if method in ("naive", "drift", "mean"):
        s = with_index(g, ts, freq, by).where(F.col("y").isNotNull()).groupBy(*by).agg(
            F.max_by("y", ts).alias("_last_y"), F.min_by("y", ts).alias("_first_y"), F.max(ts).alias("_last"),
            (F.max("idx") - F.min("idx")).alias("_n"), F.avg("y").alias("_mean"))
        f = _future(s, ts, horizon, freq, by, at)
        yhat = {"naive": F.col("_last_y"), "mean": F.col("_mean"),
                "drift": F.col("_last_y") + F.col("step") * (F.col("_last_y") - F.col("_first_y")) / F.when(
                    F.col("_n") > 0, F.col("_n"))}[method]
        return f.select(*by, "step", ts, yhat.alias("yhat"))
    if method not in ("seasonal_naive", "trend_season"):
        raise ValueError(f"unknown method {method!r}")
    if not period:
        raise ValueError(f"{method} needs a period")
    if method == "seasonal_naive":
        gi = with_index(g, ts, freq, by)
        last = gi.groupBy(*by).agg(F.max(ts).alias("_last"), F.max("idx").alias("_n"))
        fut = _future(last, ts, horizon, freq, by, at).withColumn(
            "idx", F.col("_n") - period + 1 + (F.col("step") - 1) % period)
        j = join_on_keys(fut, gi.select(*by, "idx", "y"), [*by, "idx"], "left")
        return j.select(*by, "step", ts, F.col("y").alias("yhat"))
    # line through the decomposition's trend component (centred moving
    # average), so the within-season ramp does not leak into the slope
    dec = _decompose(g, ts, freq, period, "additive", "y", by)
    x = F.col("idx").cast("double")
    base = dec.groupBy(*by).agg(F.regr_slope("trend", x).alias("slope"), F.regr_intercept("trend", x).alias("intercept"),
                                F.max(ts).alias("_last"), F.max("idx").alias("_n"))
    seas = dec.groupBy(*by, "phase").agg(F.max("seasonal").alias("seasonal"))
    fut = _future(base, ts, horizon, freq, by, at).withColumn(
        "phase", (F.col("_n") + F.col("step")) % period)
    j = join_on_keys(fut, seas, [*by, "phase"], "left")
    yhat = F.col("intercept") + F.col("slope") * (F.col("_n") + F.col("step")) + F.col("seasonal")
    return j.select(*by, "step", ts, yhat.alias("yhat"))


def backtest(grid: DataFrame, ts: str, horizon: int, method: str = "naive", freq: str = "month",
             period: int | None = None, y: str = "y", by: Sequence[str] = (), **kw) -> DataFrame:
    """Hold out each series' last ``horizon`` steps, forecast them from the
    rest, and score the steps that were observed: n, mae, rmse, mape (over
    non-zero actuals).  A series with nothing to score has n = 0."""
    by = list(by)
    g = with_index(grid.select(*by, ts, nan_to_null(y).alias("y")), ts, freq, by)
    g = g.withColumn("_rest", F.max("idx").over(Window.partitionBy(*by)) - F.col("idx"))
    train = g.where(F.col("_rest") >= horizon).select(*by, ts, "y")
    test = g.where(F.col("_rest") < horizon).select(*by, ts, F.col("y").alias("_actual"))
    # sparse series have far fewer rows to score than steps: only theirs are forecast
    fc = forecast(train, ts, horizon, method, freq, period, "y", by, at=test.select(*by, ts).distinct(), **kw).select(*by, ts, "yhat")
    j = join_on_keys(test, fc, [*by, ts], "left")
    e = F.col("_actual") - F.col("yhat")
    return j.groupBy(*by).agg(
        F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.when(F.col("_actual") != 0, F.abs(e / F.col("_actual")))).alias("mape"))


# -------------------------------------------------------------------- T11
def lag_features(grid: DataFrame, ts: str, freq: str, lags: Sequence[int] = (1,), y: str = "y",
                 by: Sequence[str] = ()) -> DataFrame:
    """lag_k for each k (in steps of the calendar), first difference and
    percent change; NULL where the earlier step is missing."""
    v, w = nan_to_null(y), _iw(by)
    out = with_index(grid, ts, freq, by)
    for k in lags:
        out = out.withColumn(f"lag_{k}", _at_step(v, w, -k))
    prev = _at_step(v, w, -1)
    out = out.withColumn("diff_1", v - prev).withColumn("pct_change_1", F.try_divide(v - prev, prev))
    return out.drop("idx")


# -------------------------------------------------------------------- T12
def acf(grid: DataFrame, ts: str, freq: str, max_lag: int, y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Sample autocorrelation r_k = sum (y_t - m)(y_(t+k) - m) / sum (y_t - m)^2
    for k = 1..max_lag (in steps of the calendar; pairs with a missing step
    add nothing), per series; one aggregate over the lead columns."""
    by = list(by)
    g = with_index(grid.select(*by, ts, nan_to_null(y).alias("y")), ts, freq, by)
    mean = F.avg("y").over(Window.partitionBy(*by))
    g = g.select(*by, "idx", (F.col("y") - mean).alias("_d"))
    w = _iw(by)
    g = g.select(*by, "_d", *[_at_step(F.col("_d"), w, k).alias(f"_l{k}") for k in range(1, max_lag + 1)])
    den = F.sum(F.col("_d") * F.col("_d"))
    one = g.groupBy(*by).agg(den.alias("_den"), *[
        F.sum(F.col("_d") * F.col(f"_l{k}")).alias(f"_n{k}") for k in range(1, max_lag + 1)])
    return one.select(*by, F.inline(F.array(*[
        F.struct(F.lit(k).cast("long").alias("lag"),
                 (F.col(f"_n{k}") / F.when(F.col("_den") != 0, F.col("_den"))).alias("acf"))
        for k in range(1, max_lag + 1)])))
