"""Descriptive statistics, distributions, correlation, dashboard (D1-D11).

Every statistic over many columns is one aggregate over the table (one scan,
partial aggregation on the map side), reshaped to long form afterwards.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.functions.stats import (
    as_col,
    join_on_keys,
    nan_to_null,
    numeric_columns,
    pair_moments,
    quantiles,
    running_sums,
)
from tally.operators.charts import thin_lines

QUARTILES = (0.25, 0.5, 0.75)
DIST_PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def _at(arr: str, i: int) -> Column:
    return F.try_element_at(F.col(arr), F.lit(i + 1))


def _explode_structs(one_row: DataFrame, names: Sequence[str]) -> DataFrame:
    return one_row.select(F.inline(F.array(*[F.col(n) for n in names])))


# --------------------------------------------------------------------- D1
def _long_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(variable, value)`` of every numeric column, NaN as NULL."""
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("variable"), nan_to_null(c).alias("value")) for c in cols])))


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None,
                     exact: bool = True) -> DataFrame:
    """count, mean, std (sample), min, 25/50/75 % (linear interpolation), max;
    one row per column.  NaN counts as missing.

    Moments: one aggregate over all columns.  Quartiles: exact, by distributed
    ranking of the long (column, value) form (``functions.stats.quantiles``),
    or with ``exact=False`` the bounded sketch ``percentile_approx`` inside
    the single pass."""
    cols = list(cols or numeric_columns(df))
    aggs = []
    for i, c in enumerate(cols):
        x = nan_to_null(c)
        fields = [F.lit(c).alias("variable"), F.count(x).alias("count"), F.avg(x).alias("mean"),
                  F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")]
        if not exact:
            fields.append(F.percentile_approx(x, list(QUARTILES), 10000).cast("array<double>").alias("_q"))
        aggs.append(F.struct(*fields).alias(f"_s{i}"))
    mom = _explode_structs(df.agg(*aggs), [f"_s{i}" for i in range(len(cols))])
    if exact:
        # both sides: one row per column
        mom = mom.join(quantiles(_long_numeric(df, cols), "value", QUARTILES, by=["variable"]), on="variable", how="left")
    return mom.select("variable", "count", "mean", "std", "min", _at("_q", 0).alias("p25"),
                      _at("_q", 1).alias("p50"), _at("_q", 2).alias("p75"), "max")


# --------------------------------------------------------------------- D2
def _long_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("variable"), as_col(c).cast("string").alias("value"))
        for c in cols])))


def describe_categorical(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count (non-null), unique, top (most frequent; ties -> smallest value),
    freq; one row per column.  Value counts are a partial aggregate, and the
    top value is a bounded ``min_by`` per column, so a hot value or a column
    with millions of distinct values stays distributed."""
    counts = _long_values(df, cols).groupBy("variable", "value").agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy("variable").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("_n"))), F.lit(0)).cast("long").alias("count"),
        F.count("value").alias("unique"),
        F.min_by("value", F.struct(F.col("value").isNull(), -F.col("_n"), F.col("value"))).alias("top"),
        F.max(F.when(F.col("value").isNotNull(), F.col("_n"))).alias("freq"),
    )


# --------------------------------------------------------------------- D3
def value_counts(df: DataFrame, col: str, top: int | None = None,
                 dropna: bool = True) -> DataFrame:
    """Frequency and share of each value; ``top`` keeps the k most frequent
    (ties -> smaller value first) as a bounded top-k."""
    base = df.where(as_col(col).isNotNull()) if dropna else df
    counts = base.groupBy(as_col(col)).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias("_tot"))
    out = (counts.crossJoin(F.broadcast(total))
           .select(as_col(col), "count", (F.col("count") / F.col("_tot")).alias("share")))
    if top is not None:
        out = out.orderBy(F.col("count").desc(), as_col(col).asc_nulls_last()).limit(top)
    return out


# --------------------------------------------------------------------- D4
def overview(df: DataFrame, exact_distinct: bool = False) -> DataFrame:
    """Per column: type, rows, missing values (NULL, or NaN in a floating
    column), their share, distinct values.  One scan.
    ``exact_distinct=False`` uses HyperLogLog++ (bounded memory per column)."""
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, f in enumerate(fields):
        c = as_col(f.name)
        if f.dataType.simpleString() in ("double", "float"):
            c = F.when(~F.isnan(c), c)
        nd = F.count_distinct(c) if exact_distinct else F.approx_count_distinct(c)
        aggs.append(F.struct(F.lit(f.name).alias("variable"),
                             F.lit(f.dataType.simpleString()).alias("dtype"),
                             F.count_if(c.isNull()).alias("n_null"),
                             nd.alias("n_distinct")).alias(f"_s{i}"))
    one = df.agg(*aggs)
    return (one.select("_rows", F.inline(F.array(*[F.col(f"_s{i}") for i in range(len(fields))])))
            .select("variable", "dtype", F.col("_rows").alias("n_rows"), "n_null",
                    (F.col("n_null") / F.when(F.col("_rows") > 0, F.col("_rows"))).alias("null_share"),
                    "n_distinct"))


# --------------------------------------------------------------------- D5
def distribution(df: DataFrame, col: str, exact: bool = True) -> DataFrame:
    """Moments and percentiles of one column.  ``skewness`` is the population
    g1, ``kurtosis`` the population excess kurtosis; ``skewness_adj`` is the
    bias-corrected G1 = g1 * sqrt(n(n-1)) / (n-2) that pandas reports."""
    x = nan_to_null(col)
    aggs = [F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
            F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis"),
            F.min(x).alias("min"), F.max(x).alias("max")]
    if exact:
        one = df.agg(*aggs).crossJoin(quantiles(df, col, DIST_PERCENTILES))  # both one row
    else:
        one = df.agg(*aggs, F.percentile_approx(x, list(DIST_PERCENTILES), 10000).cast("array<double>").alias("_q"))
    n = F.col("n").cast("double")
    return one.select(
        F.lit(col).alias("variable"), "n", "mean", "std", "skewness",
        (F.col("skewness") * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)).alias("skewness_adj"),
        "kurtosis", "min",
        *[_at("_q", i).alias(f"p{int(round(p * 100)):02d}") for i, p in enumerate(DIST_PERCENTILES)],
        "max")


def ecdf(df: DataFrame, col: str, buckets: int | None = None, max_points: int | None = None) -> DataFrame:
    """Empirical CDF: one row per distinct value with its count, cumulative
    count and F(x) = share of values <= x.  The running count is computed by
    range buckets (no single-partition window).  For drawing, ``max_points`` keeps
    the first and last value of each pixel column (the curve only rises, so
    those are its extremes too)."""
    vals = df.select(nan_to_null(col).alias("value")).where(F.col("value").isNotNull())
    counts = vals.groupBy("value").agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias("_tot"))
    cum = running_sums(counts, "value", ["count"], buckets=buckets, unique_order=True)
    out = (cum.crossJoin(F.broadcast(total))
           .select("value", "count", F.col("cum_count").cast("long").alias("cum_count"),
                   (F.col("cum_count") / F.col("_tot")).alias("ecdf")))
    return thin_lines(out, max_points, "value", ["ecdf"]) if max_points else out


# --------------------------------------------------------------------- D6
def normality(df: DataFrame, col: str) -> DataFrame:
    """Jarque-Bera test from the population moments: JB = n/6 (g1^2 + g2^2/4),
    p = exp(-JB/2) (chi-square with 2 degrees of freedom)."""
    x = nan_to_null(col)
    one = df.agg(F.count(x).alias("n"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis"))
    jb = F.col("n") / 6.0 * (F.col("skewness") ** 2 + F.col("kurtosis") ** 2 / 4.0)
    return one.select(F.lit(col).alias("variable"), "n", "skewness", "kurtosis",
                      jb.alias("jb"), F.exp(-jb / 2.0).alias("p_value"))


def ks_normal(df: DataFrame, col: str) -> DataFrame:
    """Kolmogorov-Smirnov test against N(mean, std) of the column itself,
    with Spark ML's distributed test.  Two scalars reach the driver.  The
    p-value takes mean and std as given, though they were estimated from the
    same column, so it is conservative (Lilliefors' case); a column without
    values has a NULL statistic."""
    from pyspark.ml.stat import KolmogorovSmirnovTest
    x = df.select(nan_to_null(col).alias("x")).where(F.col("x").isNotNull())
    m = x.agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s")).first()
    if m["m"] is None:
        return df.sparkSession.createDataFrame([(col, None, None)], "variable string, statistic double, p_value double")
    res = KolmogorovSmirnovTest.test(x, "x", "norm", float(m["m"]), float(m["s"] or 1.0))
    return res.select(F.lit(col).alias("variable"), F.col("statistic"), F.col("pValue").alias("p_value"))


# ------------------------------------------------------------------ D7 D8 D9
def _rank_vectors(df: DataFrame, cols: Sequence[str], buckets: int | None = None) -> DataFrame:
    """``_v``: per row without missing values the array of its columns' average
    ranks (ties share the mean rank).  All columns are ranked in one pass over
    the long (column, value) form: one grouped count, one running sum
    partitioned by column; the ranks return to the rows by one join on
    (column, value) and one grouping by row."""
    base = df.select(*[nan_to_null(c).alias(f"c{i}") for i, c in enumerate(cols)]).na.drop(how="any")

    def long(frame: DataFrame, *keep: str) -> DataFrame:
        return frame.select(*keep, F.inline(F.array(*[
            F.struct(F.lit(i).alias("variable"), F.col(f"c{i}").alias("value")) for i in range(len(cols))])))

    counts = long(base).groupBy("variable", "value").agg(F.count(F.lit(1)).alias("_n"))
    cum = running_sums(counts, "value", ["_n"], by=["variable"], buckets=buckets, unique_order=True)
    ranks = cum.select("variable", "value", (F.col("cum__n") - F.col("_n") + (F.col("_n") + 1) / 2.0).alias("_rank"))
    rows = long(base.withColumn("_row", F.monotonically_increasing_id()), "_row")
    # one maximum per column: collected lists would send every row through a sort
    ranked = rows.join(ranks, ["variable", "value"]).groupBy("_row").agg(
        *[F.max(F.when(F.col("variable") == i, F.col("_rank"))).alias(f"_r{i}") for i in range(len(cols))])
    return ranked.select(F.array(*[F.col(f"_r{i}") for i in range(len(cols))]).alias("_v"))


def correlation(df: DataFrame, cols: Sequence[str] | None = None, method: str = "pearson",
                full: bool = False, buckets: int | None = None) -> DataFrame:
    """Long-form correlation ``(var_x, var_y, r)``; one pass for all pairs of
    any number of columns (``functions.stats.pair_moments``).

    pearson: pairwise-complete, NULL for a constant column.
    spearman: Pearson on average ranks after dropping rows with any NULL.
    full=True adds the diagonal and both triangles (heatmap table).
    """
    cols = list(cols or numeric_columns(df))
    if method == "spearman":
        data = _rank_vectors(df, cols, buckets)
    elif method == "pearson":
        data = df.select(F.array(*[nan_to_null(c) for c in cols]).alias("_v"))
    else:
        raise ValueError(f"unknown method {method!r}")
    den = F.sqrt(F.col("cxx")) * F.sqrt(F.col("cyy"))
    r = F.when(F.col("i") == F.col("j"), F.when(F.col("cxx") > 0, F.lit(1.0))).otherwise(
        F.col("cxy") / F.when(den > 0, den))
    found = pair_moments(data, "_v", len(cols)).select("i", "j", r.alias("r"))
    # every pair has a row, also one whose columns share no row
    k = len(cols)
    pairs = [(i, j) for i in range(k) for j in range(k) if i < j or full]
    grid = df.sparkSession.createDataFrame([(cols[i], cols[j], min(i, j), max(i, j)) for i, j in pairs],
                                           "var_x string, var_y string, i int, j int")
    return grid.join(found, ["i", "j"], "left").select("var_x", "var_y", "r")


def heatmap(df: DataFrame, cols: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    """D9 — the square correlation table (diagonal and both triangles)."""
    return correlation(df, cols, method=method, full=True)


# -------------------------------------------------------------------- D10
def metric_cards(df: DataFrame, metrics: Mapping[str, Column],
                 period: Column | None = None) -> DataFrame:
    """KPI cards ``(metric, value)``.  With ``period`` (e.g. a month column)
    the cards show the last period, the one before, and the change."""
    names = list(metrics)
    if period is None:
        one = df.agg(*[metrics[m].cast("double").alias(f"_m{i}") for i, m in enumerate(names)])
        return one.select(F.inline(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(f"_m{i}").alias("value"))
            for i, m in enumerate(names)])))
    per = df.groupBy(period.alias("_period")).agg(
        *[metrics[m].cast("double").alias(f"_m{i}") for i, m in enumerate(names)])
    # one row per period; the top-2 is bounded
    last2 = per.orderBy(F.col("_period").desc()).limit(2)
    latest = last2.agg(F.max("_period").alias("_last"))
    tagged = last2.crossJoin(latest).withColumn("_cur", F.col("_period") == F.col("_last"))
    long = tagged.select("_cur", "_period", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"_m{i}").alias("v")) for i, m in enumerate(names)])))
    out = long.groupBy("metric").agg(
        F.max(F.when(F.col("_cur"), F.col("_period"))).alias("period"),
        F.max(F.when(F.col("_cur"), F.col("v"))).alias("value"),
        F.max(F.when(~F.col("_cur"), F.col("v"))).alias("previous"))
    return out.select("metric", "period", "value", "previous",
                      (F.col("value") - F.col("previous")).alias("delta"),
                      F.try_divide(F.col("value") - F.col("previous"), F.col("previous")).alias("delta_pct"))


# -------------------------------------------------------------------- D11
def insights(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (),
             missing: float = 0.05, skew: float = 1.0, corr: float = 0.7,
             outlier_share: float = 0.01, dominant: float = 0.5, k: float = 1.5) -> DataFrame:
    """Rule rows ``(rule, subject, score)``: high missing share, strong skew,
    strong correlation, many IQR outliers, one dominant category.

    One aggregate for the per-column statistics, one pass for all
    correlations, one ranking of the long form for all quartiles, one scan for
    the outlier shares against the broadcast fences, however many columns."""
    numeric, categorical = list(numeric), list(categorical)
    allc = numeric + categorical
    stats = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(allc):
        x = nan_to_null(c) if i < len(numeric) else as_col(c)
        stats.append(F.count_if(x.isNull()).alias(f"_null{i}"))
    for i, c in enumerate(numeric):
        stats.append(F.skewness(nan_to_null(c)).alias(f"_skew{i}"))
    one = df.agg(*stats)
    rows = [F.struct(F.lit("missing").alias("rule"), F.lit(c).alias("subject"),
                     F.try_divide(F.col(f"_null{i}"), F.col("_rows")).alias("score")) for i, c in enumerate(allc)]
    rows += [F.struct(F.lit("skewed").alias("rule"), F.lit(c).alias("subject"),
                      F.col(f"_skew{i}").alias("score")) for i, c in enumerate(numeric)]
    cand = one.select(F.inline(F.array(*rows)))
    if len(numeric) > 1:
        cand = cand.unionByName(correlation(df, numeric).select(
            F.lit("correlated").alias("rule"), F.concat_ws("~", "var_x", "var_y").alias("subject"), F.col("r").alias("score")))
    keep = (((F.col("rule") == "missing") & (F.col("score") > missing))
            | ((F.col("rule") == "skewed") & (F.abs(F.col("score")) > skew))
            | ((F.col("rule") == "correlated") & (F.abs(F.col("score")) > corr)))
    parts = [cand.where(keep)]
    if numeric:
        quart = quantiles(_long_numeric(df, numeric), "value", [0.25, 0.75], by=["variable"])
        # one row: the quartiles of every column
        fences = quart.agg(*[F.max(F.when(F.col("variable") == c, F.col("_q"))).alias(f"_q{i}") for i, c in enumerate(numeric)])
        flagged = df.crossJoin(F.broadcast(fences))
        oagg = []
        for i, c in enumerate(numeric):
            x = nan_to_null(c)
            q1, q3 = _at(f"_q{i}", 0), _at(f"_q{i}", 1)
            iqr = q3 - q1
            out = (x < q1 - k * iqr) | (x > q3 + k * iqr)
            oagg.append(F.struct(F.lit("outliers").alias("rule"), F.lit(c).alias("subject"),
                                 F.try_divide(F.count_if(F.coalesce(out, F.lit(False))), F.count(F.lit(1)))
                                 .alias("score"))
                        .alias(f"_o{i}"))
        outl = _explode_structs(flagged.agg(*oagg), [f"_o{i}" for i in range(len(numeric))])
        parts.append(outl.where(F.col("score") > outlier_share))
    if categorical:
        d2 = describe_categorical(df, categorical)
        parts.append(d2.select(F.lit("dominant_category").alias("rule"),
                               F.concat_ws("=", F.col("variable"), F.col("top")).alias("subject"),
                               (F.col("freq") / F.when(F.col("count") > 0, F.col("count"))).alias("score"))
                     .where(F.col("score") > dominant))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
