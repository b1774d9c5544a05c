"""Chart-ready tables (V1-V9) and row preview (B3).

A chart operator returns a table whose size is bounded by its parameters
(bins, top-k, time grid, categories): Spark computes it with partial
aggregation, and drawing it is left to the caller.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tally.functions.stats import as_col, equal_width_bin, join_on_keys, nan_to_null, quantiles

OTHER = "(other)"


def agg_expr(agg: str, y: str | Column | None) -> Column:
    """The aggregate named ``agg`` over ``y`` (``count`` without ``y`` counts
    rows); NaN counts as missing."""
    if agg == "count":
        return F.count(F.lit(1)) if y is None else F.count(as_col(y))
    c = nan_to_null(y)
    fns = {"avg": F.avg, "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max,
           "median": lambda c: F.percentile_approx(c, 0.5, 10000), "std": F.stddev_samp}
    if agg not in fns:
        raise ValueError(f"unknown aggregate {agg!r}")
    return fns[agg](c)


def trunc_ntz(c: Column, freq: str) -> Column:
    """Wall-clock truncation of a TIMESTAMP_NTZ value without passing through
    the session time zone (``date_trunc`` casts to LTZ first, which moves
    wall-clock times inside a daylight-saving gap)."""
    day = c.cast("date")
    if freq in ("year", "quarter", "month", "week"):
        return F.trunc(day, freq).cast("timestamp_ntz")
    start = day.cast("timestamp_ntz")
    if freq == "day":
        return start
    if freq == "hour":
        return F.timestamp_add("HOUR", F.hour(c), start)
    if freq == "minute":
        return F.timestamp_add("MINUTE", F.hour(c) * 60 + F.minute(c), start)
    raise ValueError(f"unsupported frequency {freq!r}")


def time_key(df: DataFrame, ts: str, freq: str | None) -> Column:
    """``ts`` truncated to ``freq`` (minute, hour, day, week (Monday), month,
    quarter, year), keeping the column's own timestamp type."""
    if not freq:
        return as_col(ts)
    dtype = df.schema[ts].dataType
    if isinstance(dtype, T.TimestampNTZType):
        return trunc_ntz(as_col(ts), freq)
    return F.date_trunc(freq, as_col(ts)).cast(dtype)


# --------------------------------------------------------------------- V1
#: Rows of a line that is drawn: more than the pixel columns of a screen.
MAX_POINTS = 2000


def axis_position(df: DataFrame, x: str) -> Column:
    """Where a value lies on a drawn axis, as a double: numbers as they are, dates in days, times in microseconds."""
    dtype, c = df.schema[x].dataType, as_col(x)
    if isinstance(dtype, T.NumericType):
        return nan_to_null(x)
    if isinstance(dtype, T.DateType):
        return F.datediff(c, F.lit("1970-01-01").cast("date")).cast("double")
    if isinstance(dtype, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c).cast("double")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c).cast("double")
    raise ValueError(f"a line needs a number or a time on its axis, {x} is {dtype.simpleString()}")


def thin_lines(table: DataFrame, max_points: int, x: str = "x", ys: Sequence[str] = ("y",),
               series: Sequence[str] = ()) -> DataFrame:
    """A chart table of at most ``max_points`` rows per series that draws the same picture.

    A series of more rows is cut into equal pixel columns along ``x``; of each column the first
    and the last row stay, and for every ``y`` the rows of its least and greatest value (ties: the
    first on the axis), so the outline and all extremes are kept.  One grouped aggregate, whose
    buffers hold those rows only.  Shorter series stay as they are; in longer ones rows without a
    place on the axis (NULL, NaN) go.  ``x`` should be unique per series."""
    if max_points < 2 + 2 * len(ys):
        raise ValueError(f"max_points must be {2 + 2 * len(ys)} or more")
    columns = max_points // (2 + 2 * len(ys))
    key = [f"_s{i}" for i in range(len(series))]
    t = table.select(F.struct("*").alias("_row"), *[as_col(c).alias(k) for c, k in zip(series, key)],
                     axis_position(table, x).alias("_x"), *[nan_to_null(y).alias(f"_y{i}") for i, y in enumerate(ys)])
    size = t.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    t = join_on_keys(t, size, key) if key else t.crossJoin(F.broadcast(size))
    long = t.where(F.col("_n") > max_points).where(F.col("_x").isNotNull())
    pixel = equal_width_bin(F.col("_x"), F.col("_lo"), F.col("_hi"), columns)
    kept = [F.min_by("_row", "_x"), F.max_by("_row", "_x")]
    for i in range(len(ys)):
        y = F.col(f"_y{i}")
        at = F.when(y.isNotNull(), F.struct(y.alias("y"), F.col("_x")))
        back = F.when(y.isNotNull(), F.struct(y.alias("y"), (-F.col("_x")).alias("_x")))
        kept += [F.min_by("_row", at), F.max_by("_row", back)]
    few = long.groupBy(*key, pixel.alias("_pixel")).agg(F.array(*kept).alias("_kept"))
    few = few.select(F.explode(F.array_distinct(F.filter("_kept", lambda r: r.isNotNull()))).alias("_row"))
    return t.where(F.col("_n") <= max_points).select("_row").unionByName(few).select("_row.*")


def line_table(df: DataFrame, x: str, y: str | None, agg: str = "avg", series: str | None = None,
               freq: str | None = None, max_points: int | None = MAX_POINTS) -> DataFrame:
    """y aggregated per x (and per series), ordered by series, x; a series of more than
    ``max_points`` values of x is thinned (:func:`thin_lines`; None, or an axis that is
    neither a number nor a time: all values)."""
    keys = ([as_col(series).alias("series")] if series else []) + [time_key(df, x, freq).alias("x")]
    out = df.groupBy(*keys).agg(agg_expr(agg, y).alias("y"))
    if max_points and isinstance(out.schema["x"].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        out = thin_lines(out, max_points, series=["series"] if series else [])
    return out.orderBy(*(["series"] if series else []), "x")


# --------------------------------------------------------------------- V2
def bar_table(df: DataFrame, cat: str, y: str | None = None, agg: str = "sum",
              top: int = 20) -> DataFrame:
    """Aggregate per category; the ``top`` largest (ties: smaller category
    first) plus one ``(other)`` row for the rest.  NULL is a category like any
    other and sorts last.  The top-k is a bounded
    TakeOrderedAndProject; the per-category aggregate is tagged with it by a
    broadcast of k rows and the rest folded into one row."""
    if agg not in ("sum", "count", "avg", "mean", "min", "max"):
        raise ValueError(f"bar_table supports sum/count/avg/min/max, not {agg!r}")
    v = F.lit(1.0) if y is None else nan_to_null(y)
    per = (df.select(as_col(cat).cast("string").alias("category"), v.alias("_v"))
           .groupBy("category")
           .agg(F.sum("_v").alias("_s"), F.count("_v").alias("_n"), F.min("_v").alias("_mn"),
                F.max("_v").alias("_mx")))

    def value(s, n, mn, mx):
        return {"sum": s, "count": n.cast("double"), "avg": F.try_divide(s, n), "mean": F.try_divide(s, n),
                "min": mn, "max": mx}[agg]

    per = per.withColumn("value", value(F.col("_s"), F.col("_n"), F.col("_mn"), F.col("_mx")))
    order = [F.col("value").desc_nulls_last(), F.col("category").asc_nulls_last()]
    # bounded top-k (TakeOrderedAndProject) ranked by a window over k rows
    topk = (per.orderBy(*order).limit(top)
            .select("category", F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank")))
    # tag the per-category rows with their rank (broadcast of k rows) and fold
    # the untagged ones into one row: the aggregate above is computed once
    tagged = join_on_keys(per, F.broadcast(topk), ["category"], "left")
    folded = tagged.groupBy(F.when(F.col("rank").isNull(), F.lit(OTHER)).otherwise(F.col("category"))
                            .alias("category"), "rank").agg(
        F.sum("_s").alias("_s"), F.sum("_n").alias("_n"), F.min("_mn").alias("_mn"), F.max("_mx").alias("_mx"))
    return folded.select("category", value(F.col("_s"), F.col("_n"), F.col("_mn"), F.col("_mx")).alias("value"),
                         "rank")


# --------------------------------------------------------------------- V3
def scatter_table(df: DataFrame, x: str, y: str, mode: str = "bins", bins: int = 50,
                  sample_every: int = 1, key: Sequence[str] | None = None) -> DataFrame:
    """mode="bins": counts on a ``bins`` x ``bins`` equal-width grid (bounded
    output at any data size).  mode="raw": the (x, y) pairs; ``sample_every``
    = m keeps the rows whose key hashes to 0 mod m (repeatable, stated by the
    caller: no hidden row cap)."""
    xs, ys = nan_to_null(x), nan_to_null(y)
    if mode == "raw":
        out = df.select(*[as_col(k) for k in (key or [])], xs.alias("x"), ys.alias("y"))
        if sample_every > 1:
            h = F.xxhash64(*[as_col(k) for k in (key or ["x", "y"])])
            out = out.where(F.pmod(h, F.lit(sample_every)) == 0)
        return out
    if mode != "bins":
        raise ValueError(f"unknown mode {mode!r}")
    pts = df.select(xs.alias("_x"), ys.alias("_y")).where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    lim = pts.agg(F.min("_x").alias("_x0"), F.max("_x").alias("_x1"),
                  F.min("_y").alias("_y0"), F.max("_y").alias("_y1"))
    b = (pts.crossJoin(F.broadcast(lim))
         .select(equal_width_bin(F.col("_x"), F.col("_x0"), F.col("_x1"), bins).alias("bin_x"),
                 equal_width_bin(F.col("_y"), F.col("_y0"), F.col("_y1"), bins).alias("bin_y"),
                 "_x0", "_x1", "_y0", "_y1"))
    g = b.groupBy("bin_x", "bin_y", "_x0", "_x1", "_y0", "_y1").agg(F.count(F.lit(1)).alias("count"))
    wx = (F.col("_x1") - F.col("_x0")) / bins
    wy = (F.col("_y1") - F.col("_y0")) / bins
    return g.select("bin_x", "bin_y",
                    (F.col("_x0") + (F.col("bin_x") - 1) * wx).alias("x_lo"),
                    (F.col("_x0") + F.col("bin_x") * wx).alias("x_hi"),
                    (F.col("_y0") + (F.col("bin_y") - 1) * wy).alias("y_lo"),
                    (F.col("_y0") + F.col("bin_y") * wy).alias("y_hi"),
                    "count")


# --------------------------------------------------------------------- V4
def histogram_table(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram; every bin appears, empty ones with count 0.
    The last bin is closed on the right (as numpy.histogram)."""
    v = df.select(nan_to_null(col).alias("_v")).where(F.col("_v").isNotNull())
    lim = v.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    counts = (v.crossJoin(F.broadcast(lim))
              .select(equal_width_bin(F.col("_v"), F.col("_lo"), F.col("_hi"), bins).alias("bin"))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("_n")))
    grid = lim.select(F.explode(F.sequence(F.lit(1).cast("long"), F.lit(bins).cast("long"))).alias("bin"),
                      "_lo", "_hi")
    w = (F.col("_hi") - F.col("_lo")) / bins
    # ``grid`` has exactly ``bins`` rows
    return (grid.join(F.broadcast(counts), on="bin", how="left")
            .select("bin", (F.col("_lo") + (F.col("bin") - 1) * w).alias("lo"),
                    (F.col("_lo") + F.col("bin") * w).alias("hi"),
                    F.coalesce(F.col("_n"), F.lit(0)).cast("long").alias("count")))


# --------------------------------------------------------------------- V5
def box_table(df: DataFrame, cat: str, y: str, k: float = 1.5, exact: bool = True) -> DataFrame:
    """Box plot per category: quartiles, whiskers (most extreme values within
    k IQR of the box) and the count of points beyond them.  NaN counts as
    missing."""
    v = nan_to_null(y)
    base = df.select(as_col(cat).alias("category"), v.alias("_v")).where(F.col("_v").isNotNull())
    if exact:
        quart = quantiles(base, "_v", [0.25, 0.5, 0.75], by=["category"])
    else:
        quart = base.groupBy("category").agg(
            F.percentile_approx("_v", [0.25, 0.5, 0.75], 10000).cast("array<double>").alias("_q"))
    # one row per category: AQE broadcasts it when small; a hot category on
    # the big side is split by the skew-join rule
    j = join_on_keys(base, quart, ["category"]).select(
        "category", "_v", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"))
    lo = F.col("q1") - k * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + k * (F.col("q3") - F.col("q1"))
    return j.groupBy("category", "q1", "median", "q3").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(F.col("_v") >= lo, F.col("_v"))).alias("whisker_lo"),
        F.max(F.when(F.col("_v") <= hi, F.col("_v"))).alias("whisker_hi"),
        F.count_if((F.col("_v") < lo) | (F.col("_v") > hi)).alias("n_outliers"))


def share_table(df: DataFrame, cat: str, y: str | None = None, agg: str = "sum") -> DataFrame:
    """Pie chart table: value per category and its share of the total."""
    per = df.groupBy(as_col(cat).alias("category")).agg(agg_expr(agg, y).cast("double").alias("value"))
    tot = per.agg(F.sum("value").alias("_tot"))
    return (per.crossJoin(F.broadcast(tot))
            .select("category", "value", (F.col("value") / F.when(F.col("_tot") != 0, F.col("_tot"))).alias("share")))


def density_table(df: DataFrame, x: str, cat: str | None = None, points: int = 128, bandwidth: float | None = None) -> DataFrame:
    """Violin or density curve: ``category, x, density`` on ``points`` equal steps, per category.

    Gaussian kernel density by linear binning: every value is shared between its two neighbours on
    a grid that reaches three bandwidths beyond the values, the bins (points per category) are
    convolved with the kernel.  ``bandwidth`` defaults to 1.06 std n^(-1/5) of the category (values
    that are all equal: 1).  The grid is the category's own; NULL and NaN are skipped, NULL is a category."""
    rows = df.select((as_col(cat) if cat else F.lit(None).cast("string")).alias("category"), nan_to_null(x).alias("v")).where(F.col("v").isNotNull())
    size = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.stddev_samp("v").alias("sd"))
    rule = F.coalesce(F.when(F.col("sd") > 0, 1.06 * F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))), F.lit(1.0))
    h = rule if bandwidth is None else F.lit(float(bandwidth))
    size = size.select("category", "n", h.alias("h"), (F.col("lo") - 3 * h).alias("start"),
                       ((F.col("hi") - F.col("lo") + 6 * h) / (points - 1)).alias("step"))
    at = (F.col("v") - F.col("start")) / F.col("step")
    low = F.least(F.floor(at), F.lit(points - 2)).cast("int")
    shared = join_on_keys(rows, size, ["category"]).select("category", low.alias("low"), (at - low).alias("part"))
    bins = shared.groupBy("category", "low").agg(F.sum(1 - F.col("part")).alias("here"), F.sum("part").alias("next"))
    bins = bins.select("category", F.explode(F.array(F.struct(F.col("low").alias("bin"), F.col("here").alias("w")),
                                                     F.struct((F.col("low") + 1).alias("bin"), F.col("next").alias("w")))).alias("b"))
    bins = bins.groupBy("category", F.col("b.bin").alias("bin")).agg(F.sum("b.w").alias("w"))
    curve = join_on_keys(bins, size, ["category"]).select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("g"))
    z = (F.col("g") - F.col("bin")) * F.col("step") / F.col("h")
    kernel = F.exp(-0.5 * z * z) / (F.col("h") * math.sqrt(2 * math.pi) * F.col("n"))
    return curve.groupBy("category", "g", "start", "step").agg(F.sum(F.col("w") * kernel).alias("density")).select(
        "category", (F.col("start") + F.col("g") * F.col("step")).alias("x"), "density")


# --------------------------------------------------------------------- V6
def compare_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Stack chart tables side by side, tagged with a ``panel`` column."""
    out = None
    for name, t in tables.items():
        tagged = t.select(F.lit(name).alias("panel"), "*")
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def compare_diff(left: DataFrame, right: DataFrame, on: Sequence[str] | str = "x",
                 value: str = "y", names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """Align two chart tables on ``on`` (full outer, NULL-safe) and give the
    difference and ratio right/left."""
    on = [on] if isinstance(on, str) else list(on)
    a = left.select(*[F.col(k).alias(f"_a_{k}") for k in on], F.col(value).alias(f"{value}_{names[0]}"))
    b = right.select(*[F.col(k).alias(f"_b_{k}") for k in on], F.col(value).alias(f"{value}_{names[1]}"))
    cond = None
    for k in on:
        c = F.col(f"_a_{k}").eqNullSafe(F.col(f"_b_{k}"))
        cond = c if cond is None else cond & c
    j = a.join(b, on=cond, how="full")
    ya, yb = F.col(f"{value}_{names[0]}"), F.col(f"{value}_{names[1]}")
    return j.select(*[F.coalesce(F.col(f"_a_{k}"), F.col(f"_b_{k}")).alias(k) for k in on], ya, yb,
                    (yb - ya).alias("delta"), F.try_divide(yb, ya).alias("ratio"))


# --------------------------------------------------------------------- V7
def overlay_tables(a: DataFrame, b: DataFrame, on: Sequence[str] | str = "x", value: str = "y",
                   names: tuple[str, str] = ("a", "b"), max_points: int | None = None) -> DataFrame:
    """Two series on one shared x axis (full outer join, NULL-safe), at most ``max_points`` rows
    when given (:func:`thin_lines` over both values; the axis is the last column of ``on``)."""
    out = compare_diff(a, b, on=on, value=value, names=names).drop("delta", "ratio")
    if not max_points:
        return out
    on = [on] if isinstance(on, str) else list(on)
    return thin_lines(out, max_points, on[-1], [f"{value}_{n}" for n in names], on[:-1])


# --------------------------------------------------------------------- V8
def slot_expr(ts: Column, slot: str) -> Column:
    """Time slot: hour of day (0-23), ISO weekday (1=Monday..7), day of month,
    month (1-12), quarter."""
    if slot == "hour":
        s = F.hour(ts)
    elif slot in ("dow", "weekday"):
        s = F.pmod(F.dayofweek(ts) + 5, F.lit(7)) + 1
    elif slot == "day":
        s = F.dayofmonth(ts)
    elif slot == "month":
        s = F.month(ts)
    elif slot == "quarter":
        s = F.quarter(ts)
    else:
        raise ValueError(f"unknown slot {slot!r}")
    return s.cast("long")


def overlay_by_slot(df: DataFrame, ts: str, y: str | None, slot: str = "hour",
                    series: str | None = "week", agg: str = "avg") -> DataFrame:
    """One line per period (``series`` = date_trunc unit) over a time slot,
    e.g. hour-of-day curves of each week, or months of each year."""
    keys = ([time_key(df, ts, series).alias("series")] if series else []) + [slot_expr(as_col(ts), slot).alias("slot")]
    return df.groupBy(*keys).agg(agg_expr(agg, y).alias("y"))


# --------------------------------------------------------------------- V9
def overlay_by_category(df: DataFrame, x: str | Column, cat: str, y: str | None,
                        values: Sequence | None = None, agg: str = "avg",
                        freq: str | None = None, other: bool = True) -> DataFrame:
    """One column per category over x.  Pass ``values`` to avoid the extra
    distinct job (and to bound the width); every other category, NULL
    included, then goes to the column ``(other)`` unless ``other`` is False."""
    xk = time_key(df, x, freq) if isinstance(x, str) else x
    if values is None:
        return df.groupBy(xk.alias("x")).pivot(cat).agg(agg_expr(agg, y))
    values = list(values)
    if not other:
        return df.groupBy(xk.alias("x")).pivot(cat, values).agg(agg_expr(agg, y))
    c = as_col(cat).cast("string")
    tagged = df.withColumn("_cat", F.when(c.isin([str(v) for v in values]), c).otherwise(F.lit(OTHER)))
    return tagged.groupBy(xk.alias("x")).pivot("_cat", [*(str(v) for v in values), OTHER]).agg(agg_expr(agg, y))


# --------------------------------------------------------------------- B3
def preview(df: DataFrame, n: int = 20, order_by: Sequence[str | Column] | None = None) -> DataFrame:
    """First ``n`` rows in a stated order (TakeOrderedAndProject: each task
    keeps its own top n, so no full sort)."""
    if order_by:
        return df.orderBy(*order_by).limit(n)
    return df.limit(n)
