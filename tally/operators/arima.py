"""ARIMA(p, d, q) by conditional sum of squares (T9), any number of series at once.

The series is differenced ``d`` times on the calendar grid.  The residuals

    e_t = w_t - c - sum phi_i w_(t-i) - sum theta_j e_(t-j)

and their derivatives by the parameters are affine in the last ``q`` residuals
and derivatives, so one scan over ranges of the series (``functions.scan``)
gives both, and their cross moments give a Gauss-Newton step: one small system
per series.  The step is tried at several lengths as variants of the series in
the next scan, and the least sum of squares is kept, so no step makes it worse.
The parameters are written between rounds.

A step whose value or ``p`` lags are missing, and the first ``skip`` steps, have
no equation: their residual is 0 (the condition of the sum of squares).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.functions.scan import Scan, ranges
from tally.functions.stats import join_on_keys, nan_to_null, run_parallel
from tally.operators.timeseries import (
    _keyed,
    _named,
    _per_series,
    _solved,
    cross_moments,
    lagged,
    least_squares,
    shift_time,
)
from tally.session import ship_package, written

#: Lengths at which a Gauss-Newton step is tried; 0 keeps what there is.
LENGTHS = (1.0, 0.5, 0.2, 0.05, 0.0)
ROUNDS = 8
#: A step below this share of its parameter ends the rounds.
TOLERANCE = 1e-7


@dataclass(frozen=True)
class Order:
    p: int
    d: int = 0
    q: int = 0
    constant: bool = True

    @property
    def names(self) -> list[str]:
        return (["constant"] if self.constant else []) + [f"ar{i}" for i in range(1, self.p + 1)] + [
            f"ma{j}" for j in range(1, self.q + 1)]


def differences(g: DataFrame, key: Sequence[str], d: int) -> DataFrame:
    """``g`` with ``w0 .. wd``: the value and its differences of the next orders, NULL where a step is missing."""
    out = g.withColumn("w0", F.col("y"))
    for i in range(d):
        before = out.select(*key, (F.col("idx") + 1).alias("idx"), F.col(f"w{i}").alias("_before"))
        out = join_on_keys(out, before, [*key, "idx"], "left")
        out = out.withColumn(f"w{i + 1}", F.col(f"w{i}") - F.col("_before")).drop("_before")
    return out


def _parts(par: Column, o: Order) -> tuple[Column, list[Column], list[Column]]:
    """The constant, the AR and the MA coefficients in a parameter array (in the order of ``names``)."""
    k = 1 if o.constant else 0
    return (par[0] if o.constant else F.lit(0.0)), [par[k + i] for i in range(o.p)], [par[k + o.p + j] for j in range(o.q)]


def _residual_step(o: Order):
    """State: for each of the last q residuals (at least one) the residual and its derivatives."""
    width = 1 + len(o.names)

    def step(s: Column, x: Column, p: Column, inputs: bool) -> Column:
        c, phi, theta = _parts(p.par, o)
        v, zero = x.cell.v, F.lit(0.0)
        lags = [v[i + 1] for i in range(o.p)]
        fresh = v[0] - c
        for f, w in zip(phi, lags):
            fresh = fresh - f * w
        base = [fresh] + ([F.lit(-1.0)] if o.constant else []) + [-w for w in lags]
        base = (base if inputs else [zero] * len(base)) + [-s[j * width] for j in range(o.q)]
        new = []
        for k, b in enumerate(base):
            for j, t in enumerate(theta):
                b = b - t * s[j * width + k]
            new.append(b)
        newest = F.when(v.isNotNull(), F.array(*new)).otherwise(F.array(*[zero] * width))
        return F.concat(newest, F.slice(s, 1, (max(o.q, 1) - 1) * width))
    return step


def _residuals(steps: DataFrame, starts: DataFrame, key: list[str], o: Order) -> Scan:
    width = 1 + len(o.names)
    start = starts.select(*key, "variant", F.array(*[F.lit(0.0)] * (width * max(o.q, 1))).alias("state"), F.struct("par").alias("p"))
    return Scan(steps, start, key, width * max(o.q, 1), _residual_step(o))


def _moments(steps: DataFrame, starts: DataFrame, key: list[str], o: Order) -> DataFrame:
    """``key, variant, m, gram``: cross moments of (derivatives, residual) over the equations."""
    k = len(o.names)
    seen = _residuals(steps, starts, key, o).steps(
        lambda _, x, s, p: F.when(x.cell.v.isNotNull(), F.concat(F.slice(s, 2, k), F.slice(s, 1, 1))))
    return cross_moments(seen.where(F.col("out").isNotNull()), [*key, "variant"], F.col("out"), k + 1)


def _gauss_newton(gram: Column) -> Column:
    """The step that takes the residual out of its derivatives."""
    @F.pandas_udf("array<double>")
    def solve(grams: pd.Series) -> pd.Series:
        out = []
        for g in grams:
            m = None if g is None else np.vstack(g)[1:, 1:]
            out.append((-least_squares(m, len(m) - 1)).tolist() if m is not None and np.isfinite(m).all() else None)
        return pd.Series(out)
    return solve(gram)


def _first_guess(w: DataFrame, rows: DataFrame, key: list[str], o: Order) -> DataFrame:
    """``key, par``: Hannan and Rissanen's two regressions (a long AR gives residuals, then their
    lags and those of the value give the parameters)."""
    long = max(2 * (o.p + o.q), 6)
    wide = lagged(w, key, "w", long)
    first = cross_moments(wide, key, F.concat(F.slice("v", 2, long), F.slice("v", 1, 1)), long + 1)
    first = first.where(F.col("m") > 2 * long).withColumn("a", _solved(F.col("gram"))).select(*key, "a")
    e = F.aggregate(F.zip_with(F.slice("a", 2, long), F.slice("v", 2, long), lambda a, v: a * v),
                    F.col("v")[0] - F.col("a")[0], lambda acc, x: acc - x)
    noise = _per_series(wide, first, key).where(F.col("a").isNotNull()).select(*key, "idx", e.alias("e"))
    joined = join_on_keys(rows.select(*key, "idx", F.col("v").alias("w")), lagged(noise, key, "e", o.q), [*key, "idx"])
    k = o.p + o.q + 1
    vector = F.concat(F.slice("w", 2, o.p), F.slice("v", 2, o.q), F.slice("w", 1, 1))
    second = cross_moments(joined, key, vector, k).where(F.col("m") > 2 * k)
    par = _solved(F.col("gram"))
    return second.select(*key, (par if o.constant else F.slice(par, 2, k)).alias("par"))


@dataclass
class Fit:
    """Parameters of every series: ``key, par, m, css, n, reason``, and what forecasts need."""

    order: Order
    params: DataFrame
    steps: DataFrame
    grid: DataFrame
    key: list[str]

    def with_aic(self) -> DataFrame:
        m, k = F.col("m"), len(self.order.names) + 1
        aic = m * F.log(F.greatest(F.col("css") / m, F.lit(1e-300))) + 2 * k
        return self.params.withColumn("aic", F.when(F.col("par").isNotNull(), aic))


def _fit(g: DataFrame, key: list[str], o: Order, rounds: int, skip: int | None) -> Fit:
    ship_package(g.sparkSession)
    skip = o.p + o.d if skip is None else skip
    grid = written(differences(g, key, o.d), "arima-grid")
    w = grid.select(*key, "idx", F.col(f"w{o.d}").alias("w")).where(F.col("w").isNotNull())
    length = grid.groupBy(*key).agg((F.max("idx") + 1).alias("n"))
    # a value serves the steps after it: the last ones have no value of their own and drop out
    rows = lagged(w, key, "w", o.p).where(F.col("idx") >= skip)
    every = length.select(*key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("idx"))
    cells = join_on_keys(every, rows, [*key, "idx"], "left").select(*key, "idx", F.struct("v").alias("cell"))
    steps = written(ranges(cells, length, key), "arima-steps")
    rows = steps.select(*key, F.inline("_steps")).where(F.col("cell.v").isNotNull()).select(*key, "idx", "cell.v")
    k = len(o.names)
    enough = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("m"), F.avg(F.col("v")[0]).alias("mean"))
    series = _left(length, enough, key).select(*key, "n", F.coalesce("m", F.lit(0)).alias("m"), "mean")
    fitted = series.where(F.col("m") > k + 1)
    plain = F.array(*([F.col("mean")] if o.constant else []), *[F.lit(0.0)] * (o.p + o.q))
    tried = fitted.select(*key, F.lit(0).alias("variant"), plain.alias("par"))
    if o.q:
        guess = _per_series(fitted.select(*key), _first_guess(w, rows, key, o), key).where(F.col("par").isNotNull())
        tried = tried.unionByName(guess.select(*key, F.lit(1).alias("variant"), "par"))
    tried = written(tried, "arima-tried")
    lengths = F.array(*[F.struct(F.lit(j).alias("variant"), F.lit(x).alias("x")) for j, x in enumerate(LENGTHS)])
    for _ in range(rounds if o.q else 1):
        best = written(_best(steps, tried, key, o).withColumn("step", _gauss_newton(F.col("gram"))), "arima-best")
        tried = best.select(*key, "par", "step", F.inline(lengths)).select(
            *key, "variant", F.when(F.col("step").isNull(), F.col("par")).otherwise(
                F.zip_with("par", "step", lambda v, s: v + F.col("x") * s)).alias("par"))
        if not best.where(F.exists(F.zip_with("par", "step", lambda v, s: F.abs(s) > TOLERANCE * (1 + F.abs(v))), lambda x: x)).take(1):
            break  # no series has a step left
    best = _best(steps, tried, key, o).select(*key, "par", F.col("gram")[k + 1][k + 1].alias("css"))
    params = _left(series.select(*key, "n", "m"), best, key).withColumn("reason", F.when(
        F.col("par").isNull(), F.lit(f"too few steps for {k} parameters")))
    return Fit(o, written(params, "arima-params"), steps, grid, key)


def _left(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    return join_on_keys(a, b, key, "left") if key else a.join(b, how="left")  # without keys: one row, or none


def _best(steps: DataFrame, tried: DataFrame, key: list[str], o: Order) -> DataFrame:
    """The variant of the least sum of squares (ties: the smallest number) with its moments."""
    k = len(o.names)
    found = _moments(steps, tried, key, o)
    css = F.col("gram")[k + 1][k + 1]
    found = join_on_keys(tried, found, [*key, "variant"]).withColumn(
        "_rank", F.struct(F.when(F.isnan(css), F.lit(float("inf"))).otherwise(css).alias("css"), "variant"))
    return found.groupBy(*key).agg(F.min_by(F.struct("par", "gram"), "_rank").alias("_b")).select(*key, "_b.*")


def _forecasts(fit: Fit, horizon: int) -> DataFrame:
    """``key, step, yhat``: the recursion without new noise, summed back ``d`` times.

    Among the last ``p`` differences a missing one counts as their mean; the level (and slope) is
    the last known one."""
    o, key = fit.order, fit.key
    g = join_on_keys(fit.grid, fit.params.select(*key, "n"), key) if key else fit.grid.crossJoin(fit.params.select("n"))
    w = F.col(f"w{o.d}")
    ends = g.groupBy(*key).agg(
        F.avg(w).alias("_mean"),
        F.array(*[F.max_by(F.col(f"w{i}"), F.when(F.col(f"w{i}").isNotNull(), F.col("idx"))) for i in range(o.d)]).cast(
            "array<double>").alias("_levels"),
        F.array(*[F.max(F.when(F.col("idx") == F.col("n") - 1 - i, w)) for i in range(o.p)]).cast("array<double>").alias("_lags"))
    starts = fit.params.where(F.col("par").isNotNull()).select(*key, F.lit(0).alias("variant"), "par")
    final = _residuals(fit.steps, starts, key, o).final.select(*key, "state", F.col("p.par").alias("par"))
    s = _per_series(final, ends, key)
    width = 1 + len(o.names)
    noise = F.array(*[F.col("state")[j * width] for j in range(o.q)]).cast("array<double>")
    lags = F.transform("_lags", lambda x: F.coalesce(x, F.col("_mean"), F.lit(0.0)))
    s = s.select(*key, "par", "_levels", lags.alias("_lags"), noise.alias("_noise"))
    c, phi, theta = _parts(F.col("par"), o)

    def ahead(acc: Column, _: Column) -> Column:
        new = c
        for i, f in enumerate(phi):
            new = new + f * acc.lags[i]
        for j, t in enumerate(theta):
            new = new + t * acc.noise[j]
        levels: list[Column] = []
        for i in range(o.d - 1, -1, -1):  # the highest difference first
            levels.insert(0, acc.levels[i] + (levels[0] if levels else new))
        return F.struct(
            F.concat(acc.out, F.array(levels[0] if levels else new)).alias("out"),
            F.array(*levels).cast("array<double>").alias("levels"),
            (F.concat(F.array(new), F.slice(acc.lags, 1, o.p - 1)) if o.p else acc.lags).alias("lags"),
            (F.concat(F.array(F.lit(0.0)), F.slice(acc.noise, 1, o.q - 1)) if o.q else acc.noise).alias("noise"))

    begin = F.struct(F.array().cast("array<double>").alias("out"), F.col("_levels").alias("levels"),
                     F.col("_lags").alias("lags"), F.col("_noise").alias("noise"))
    out = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), begin, ahead).out
    return s.select(*key, F.posexplode(out).alias("_h", "yhat")).select(*key, (F.col("_h") + 1).cast("long").alias("step"), "yhat")


def arima(grid: DataFrame, ts: str, freq: str, order: tuple[int, int, int], y: str = "y", by: Sequence[str] = (),
          constant: bool = True, rounds: int = ROUNDS) -> DataFrame:
    """One row per series: ``constant, ar1.., ma1..`` (NULL where the series is too short, which
    ``reason`` says), ``n`` equations, ``sigma2`` = CSS / n and ``aic`` = n ln(sigma2) + 2 (parameters + 1)."""
    g, key = _keyed(grid, ts, freq, y, by)
    o = Order(*order, constant=constant)
    fit = _fit(g, key, o, rounds, None).with_aic()
    return _named(fit, key, by, [*[F.col("par")[i].alias(c) for i, c in enumerate(o.names)], F.col("m").alias("n"),
                                 (F.col("css") / F.col("m")).alias("sigma2"), "aic", "reason"])


def forecast_arima(grid: DataFrame, ts: str, freq: str, horizon: int, order: tuple[int, int, int], y: str = "y",
                   by: Sequence[str] = (), constant: bool = True, rounds: int = ROUNDS) -> DataFrame:
    """``horizon`` future steps per series: ``(by..., step, ts, yhat, reason)``."""
    g, key = _keyed(grid, ts, freq, y, by)
    fit = _fit(g, key, Order(*order, constant=constant), rounds, None)
    return _dated(g, key, by, ts, freq, horizon, fit.params, _forecasts(fit, horizon))


def _dated(g: DataFrame, key: list[str], by: Sequence[str], ts: str, freq: str, horizon: int, series: DataFrame,
           ahead: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    last = g.groupBy(*key).agg(F.max("ts").alias("_last"))
    steps = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(horizon).cast("long"))).alias("step")
    grid = _per_series(series.select(*key, "reason", *more), last, key).select(*key, "_last", "reason", *more, steps)
    out = join_on_keys(grid, ahead, [*key, "step"], "left")
    return _named(out, key, by, [F.col("step"), shift_time(F.col("_last"), F.col("step"), freq).alias(ts),
                                 nan_to_null("yhat").alias("yhat"), *[F.col(c) for c in more], F.col("reason")])


def choose_arima(grid: DataFrame, ts: str, freq: str, horizon: int, orders: Sequence[tuple[int, int, int]], y: str = "y",
                 by: Sequence[str] = (), constant: bool = True, rounds: int = ROUNDS) -> DataFrame:
    """Forecasts of the order of least AIC per series: ``(by..., step, ts, yhat, chosen, aic, reason)``.

    All orders must share ``d`` (AIC compares fits of the same values), and all are fitted to the same
    equations: those of the longest lag."""
    if len({d for _, d, _ in orders}) != 1:
        raise ValueError("AIC compares orders of the same d only")
    g, key = _keyed(grid, ts, freq, y, by)
    skip = max(p for p, _, _ in orders) + orders[0][1]
    fits = run_parallel(lambda o: _fit(g, key, Order(*o, constant=constant), rounds, skip), list(orders))
    table = None
    for i, f in enumerate(fits):
        one = f.with_aic().select(*key, F.lit(i).alias("_o"), "aic", "reason")
        table = one if table is None else table.unionByName(one)
    best = table.groupBy(*key).agg(F.min_by(F.struct("_o", "aic", "reason"), F.struct(
        F.coalesce("aic", F.lit(float("inf"))).alias("a"), "_o")).alias("_b")).select(*key, "_b.*")
    best = written(best, "arima-chosen")
    names = F.array(*[F.lit(f"({p},{d},{q})") for p, d, q in orders])
    ahead = None
    for i, f in enumerate(fits):
        one = _forecasts(f, horizon).withColumn("_o", F.lit(i))
        ahead = one if ahead is None else ahead.unionByName(one)
    if key:
        mine = join_on_keys(ahead, best.select(*key, "_o"), [*key, "_o"], "left_semi")
    else:
        mine = ahead.join(best.select("_o"), "_o", "left_semi")
    series = best.withColumn("chosen", F.when(F.col("aic").isNotNull(), F.get(names, F.col("_o"))))
    return _dated(g, key, by, ts, freq, horizon, series, mine.drop("_o"), ["chosen", "aic"])
