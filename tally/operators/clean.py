"""Preprocessing (C1-C11): missing values, outliers, types, derived columns,
duplicates, text cleaning, scaling, encoding.

Statistics that feed back into rows (means, modes, fences, scale factors)
are computed by one aggregate and joined back as a broadcast one-row frame,
so plans stay lazy and nothing is collected to the driver.  Per-group
statistics are a grouped aggregate joined back on the group key (AQE picks
broadcast or a skew-split shuffle join at run time) — never a window over a
possibly hot group.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.functions.gram import moments
from tally.functions.stats import as_col, bucket_count, count_below, join_on_keys, nan_to_null, quantiles
from tally.session import scratch_path

SAMPLED = 4096  # values of a column, at least, by which encode_mapping cuts its ranges (twice as many at most)
CUT_CHARS = 64
WS_PATTERN = r"[ \t\n\r\f]+"


def _null_safe_on(keys: Sequence[str], left: str, right: str) -> Column:
    cond = None
    for k in keys:
        c = F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
        cond = c if cond is None else cond & c
    return cond


def _replace_cols(df: DataFrame, new: Mapping[str, Column], alias: str | None = None) -> DataFrame:
    """Select the original columns in order, swapping in ``new`` ones."""
    out = []
    for c in df.columns:
        src = F.col(f"{alias}.`{c}`") if alias else F.col(f"`{c}`")
        out.append(new[c].alias(c) if c in new else src)
    out += [v.alias(k) for k, v in new.items() if k not in df.columns]
    return out


# --------------------------------------------------------------------- C1
def drop_missing(df: DataFrame, how: str = "any", subset: Sequence[str] | None = None,
                 thresh: int | None = None) -> DataFrame:
    """Remove rows with missing values (``how`` any/all over ``subset``)."""
    return df.na.drop(how=how, thresh=thresh, subset=list(subset) if subset else None)


# --------------------------------------------------------------------- C2
def impute_mean(df: DataFrame, cols: Sequence[str], by: Sequence[str] | None = None) -> DataFrame:
    """Replace NULL/NaN by the column mean (overall, or per ``by`` group).
    Imputed columns become double."""
    cols = list(cols)
    if not by:
        means = df.agg(*[F.avg(nan_to_null(c)).alias(f"_mean_{c}") for c in cols])
        j = df.alias("l").crossJoin(F.broadcast(means))
        return j.select(*_replace_cols(df, {c: F.coalesce(nan_to_null(F.col(f"l.`{c}`")), F.col(f"`_mean_{c}`"))
                                            for c in cols}, "l"))
    by = list(by)
    means = df.groupBy(*by).agg(*[F.avg(nan_to_null(c)).alias(f"_mean_{c}") for c in cols])
    j = df.alias("l").join(means.alias("m"), on=_null_safe_on(by, "l", "m"), how="left")
    return j.select(*_replace_cols(df, {c: F.coalesce(nan_to_null(F.col(f"l.`{c}`")), F.col(f"m.`_mean_{c}`"))
                                        for c in cols}, "l"))


# --------------------------------------------------------------------- C3
def _present(df: DataFrame, c: str, x: Column | None = None) -> Column:
    """The column's value in its own type, NaN as NULL."""
    x = as_col(c) if x is None else x
    return F.when(~F.isnan(x), x) if df.schema[c].dataType.simpleString() in ("double", "float") else x


def column_modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: the most frequent value of each column, NULL and NaN aside
    (ties -> smallest value), as ``_mode_<column>``.  One scan: the value counts of all columns are one aggregate
    over grouping sets (partial aggregation), each mode a bounded ``min_by``,
    so a column with billions of distinct values never lands in one task."""
    cols = list(cols)
    names = [f"c{i}" for i in range(len(cols))]
    base = df.select(*[_present(df, c).alias(n) for c, n in zip(cols, names)])
    counts = base.groupingSets([[F.col(n)] for n in names], *names).agg(
        F.count(F.lit(1)).alias("_n"), F.grouping_id().alias("_g"))
    every = (1 << len(cols)) - 1
    modes = []
    for i, (c, n) in enumerate(zip(cols, names)):
        mine = (F.col("_g") == (every & ~(1 << (len(cols) - 1 - i)))) & F.col(n).isNotNull()
        modes.append(F.min_by(F.col(n), F.when(mine, F.struct(-F.col("_n"), F.col(n)))).alias(f"_mode_{c}"))
    return counts.agg(*modes)


def impute_mode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace NULL and NaN by the column mode; works for strings and numbers
    (Spark ML's Imputer rejects strings)."""
    cols = list(cols)
    modes = column_modes(df, cols)
    j = df.alias("l").crossJoin(F.broadcast(modes))
    return j.select(*_replace_cols(df, {c: F.coalesce(_present(df, c, F.col(f"l.`{c}`")), F.col(f"`_mode_{c}`"))
                                        for c in cols}, "l"))


# ------------------------------------------------------------------ C4 C5
def flag_outliers(df: DataFrame, col: str, method: str = "iqr", k: float | None = None,
                  by: Sequence[str] | None = None, flag: str = "is_outlier") -> DataFrame:
    """Add ``is_outlier``: outside [q1 - k IQR, q3 + k IQR] (method="iqr",
    k=1.5) or |x - mean| / std > k (method="zscore", k=3, sample std).
    NULL counts as not an outlier."""
    x = nan_to_null(col)
    if method == "iqr":
        k = 1.5 if k is None else k
    elif method == "zscore":
        k = 3.0 if k is None else k
    else:
        raise ValueError(f"unknown method {method!r}")
    by = list(by or [])
    if method == "iqr":
        s = quantiles(df, col, [0.25, 0.75], by=by)
    elif by:
        s = df.groupBy(*by).agg(F.avg(x).alias("_mu"), F.stddev_samp(x).alias("_sd"))
    else:
        s = df.agg(F.avg(x).alias("_mu"), F.stddev_samp(x).alias("_sd"))
    if by:
        # one row per group; AQE picks broadcast or a skew-split shuffle join
        j = df.alias("l").join(s.alias("m"), on=_null_safe_on(by, "l", "m"), how="left")
    else:
        j = df.alias("l").crossJoin(F.broadcast(s.alias("m")))
    v = nan_to_null(F.col(f"l.`{col}`"))
    if method == "iqr":
        q1, q3 = F.try_element_at(F.col("m._q"), F.lit(1)), F.try_element_at(F.col("m._q"), F.lit(2))
        out = (v < q1 - k * (q3 - q1)) | (v > q3 + k * (q3 - q1))
    else:
        sd = F.col("m._sd")
        out = F.when(sd > 0, F.abs(v - F.col("m._mu")) / sd > k)  # constant column: no outliers
    return j.select(*[F.col(f"l.`{c}`") for c in df.columns], F.coalesce(out, F.lit(False)).alias(flag))


def chi2_quantile(p: float, k: int) -> float:
    """The chi-square quantile ``p`` with ``k`` degrees of freedom, by bisection of the exact upper tail."""
    def above(x: float) -> float:
        h = x / 2
        tail = math.erfc(math.sqrt(h)) if k % 2 else math.exp(-h)
        for m in range(4 - k % 2, k + 1, 2):  # from 1 (or 2) degrees of freedom up to k in steps of 2
            tail += math.exp((m / 2 - 1) * math.log(h) - h - math.lgamma(m / 2)) if h > 0 else 0.0
        return tail
    lo, hi = 0.0, float(k)
    while above(hi) > 1 - p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if above(mid) > 1 - p else (lo, mid)
    return hi


def flag_outliers_joint(df: DataFrame, cols: Sequence[str], p: float = 0.999, limit: float | None = None,
                        flag: str = "is_outlier", distance: str = "mahalanobis2") -> DataFrame:
    """Add the squared Mahalanobis distance over ``cols`` (sample covariance) and whether it exceeds
    ``limit``, by default the chi-square quantile ``p``: rows that are unusual together though no single
    column is.  Two aggregates give the means and the products; the distance is plain arithmetic with
    the inverse (columns x columns) in the plan.  Rows with a missing value have no distance and are
    no outliers; columns that depend on each other count once."""
    xs = [nan_to_null(c) for c in cols]
    present = F.lit(True)
    for x in xs:
        present = present & x.isNotNull()
    m = moments(df.select(*[x.alias(f"_x{i}") for i, x in enumerate(xs)]).na.drop(), [F.col(f"_x{i}") for i in range(len(xs))])
    d2 = F.when(present, m.form(xs, m.inverse()) * max(m.n - 1, 0))
    limit = chi2_quantile(p, len(cols)) if limit is None else limit
    return df.withColumn(distance, d2).withColumn(flag, F.coalesce(as_col(distance) > limit, F.lit(False)))


def drop_outliers(df: DataFrame, col: str, method: str = "iqr", k: float | None = None,
                  by: Sequence[str] | None = None) -> DataFrame:
    return flag_outliers(df, col, method, k, by, flag="_is_out").where(~F.col("_is_out")).drop("_is_out")


# ------------------------------------------------------------------ C6 C7
def _to_type(c: Column, dtype: str, safe: bool) -> Column:
    return c.try_cast(dtype) if safe else c.cast(dtype)


def convert_types(df: DataFrame, types: Mapping[str, str], errors: str = "null") -> DataFrame:
    """Cast columns; ``errors="null"`` turns unparseable values into NULL
    (``try_cast``), ``errors="raise"`` fails the job (ANSI ``cast``)."""
    if errors not in ("null", "raise"):
        raise ValueError("errors must be 'null' or 'raise'")
    return df.select(*_replace_cols(df, {c: _to_type(as_col(c), t, errors == "null") for c, t in types.items()}))


def conversion_report(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Per column: non-NULL values, values that would fail the cast, share."""
    aggs = []
    for i, (c, t) in enumerate(types.items()):
        fail = F.count_if(as_col(c).isNotNull() & as_col(c).try_cast(t).isNull())
        aggs.append(F.struct(F.lit(c).alias("variable"), F.lit(t).alias("target_type"),
                             F.count(as_col(c)).alias("n_nonnull"), fail.alias("n_failed")).alias(f"_s{i}"))
    one = df.agg(*aggs).select(F.inline(F.array(*[F.col(f"_s{i}") for i in range(len(types))])))
    return one.withColumn("fail_share", F.col("n_failed") / F.when(F.col("n_nonnull") > 0, F.col("n_nonnull")))


# --------------------------------------------------------------------- C8
def derive(df: DataFrame, exprs: Mapping[str, str | Column]) -> DataFrame:
    """New columns from Spark SQL expressions (the whole scalar function
    surface: arithmetic, math, string, date, CASE WHEN, ...)."""
    return df.withColumns({k: (F.expr(v) if isinstance(v, str) else v) for k, v in exprs.items()})


# --------------------------------------------------------------------- C9
def drop_duplicates(df: DataFrame, subset: Sequence[str] | None = None,
                    order_by: Sequence[str] | None = None) -> DataFrame:
    """Keep one row per ``subset`` key: the first by ``order_by`` (ties and
    no order: the smallest row).  Unlike ``dropDuplicates`` the survivor is
    deterministic, and unlike ``row_number`` over the key it is a partial
    aggregate: a key holding a third of all rows is reduced map-side."""
    if not subset:
        return df.distinct()
    subset = list(subset)
    rest = [c for c in df.columns if c not in subset]
    if not rest:
        return df.select(*[as_col(c) for c in subset]).distinct()
    order = [as_col(c) for c in (order_by or [])] + [as_col(c) for c in rest]
    # min_by over a struct buffer runs as a sort-based aggregate; leading the
    # grouping key with a 64-bit hash of the key (a function of it, so the
    # groups do not change) settles most sort comparisons without comparing
    # long keys such as whole texts
    g = df.groupBy(F.xxhash64(*[as_col(c) for c in subset]).alias("_h"), *[as_col(c) for c in subset]).agg(
        F.min_by(F.struct(*[as_col(c) for c in rest]), F.struct(*order)).alias("_row"))
    return g.select(*[F.col(f"_row.`{c}`").alias(c) if c in rest else as_col(c) for c in df.columns])


def clean_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Collapse runs of ASCII whitespace to one space, trim, and turn empty
    strings into NULL — over the whole text."""
    return df.select(*_replace_cols(df, {
        c: F.nullif(F.trim(F.regexp_replace(as_col(c), WS_PATTERN, " ")), F.lit("")) for c in cols}))


# -------------------------------------------------------------------- C10
def scale(df: DataFrame, cols: Sequence[str], how: str = "standard") -> DataFrame:
    """standard: (x - mean) / std (sample); minmax: (x - min) / (max - min),
    NULL for a constant column; log: ln(1 + x), NULL for x <= -1."""
    cols = list(cols)
    if how == "log":
        return df.select(*_replace_cols(df, {
            c: F.when(nan_to_null(c) > -1, F.ln(F.lit(1.0) + nan_to_null(c))) for c in cols}))
    if how == "standard":
        st = df.agg(*[F.avg(nan_to_null(c)).alias(f"_a_{c}") for c in cols],
                     *[F.stddev_samp(nan_to_null(c)).alias(f"_b_{c}") for c in cols])

        def f(c):
            sd = F.col(f"`_b_{c}`")
            return (nan_to_null(F.col(f"l.`{c}`")) - F.col(f"`_a_{c}`")) / F.when(sd != 0, sd)
    elif how == "minmax":
        st = df.agg(*[F.min(nan_to_null(c)).alias(f"_a_{c}") for c in cols],
                    *[F.max(nan_to_null(c)).alias(f"_b_{c}") for c in cols])

        def f(c):
            rng = F.col(f"`_b_{c}`") - F.col(f"`_a_{c}`")
            return (nan_to_null(F.col(f"l.`{c}`")) - F.col(f"`_a_{c}`")) / F.when(rng != 0, rng)
    else:
        raise ValueError(f"unknown scaling {how!r}")
    j = df.alias("l").crossJoin(F.broadcast(st))
    return j.select(*_replace_cols(df, {c: f(c) for c in cols}, "l"))


# -------------------------------------------------------------------- C11
def encode_mapping(df: DataFrame, cols: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Category -> index, by frequency (descending) then value (ascending),
    0-based, per column; the same order as StringIndexer(frequencyDesc).

    No window runs over all values of a column: a value's index is the number of values
    of higher counts (a window over the different counts, of which n rows have at most
    sqrt(2 n)) plus its place among those of its own count.  These are cut into ranges at values drawn by their hash (about
    ``SAMPLED`` prefixes of ``CUT_CHARS`` characters a column; any cuts give the same
    index), each range numbered by itself, after the sizes of the ranges before it."""
    n_b = bucket_count(df, buckets)
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("variable"), as_col(c).cast("string").alias("value")) for c in cols])))
    counts = long.where(F.col("value").isNotNull()).groupBy("variable", "value").agg(
        F.count(F.lit(1)).alias("count"))
    sizes = counts.groupBy("variable").agg(F.greatest(F.floor(F.count(F.lit(1)) / SAMPLED), F.lit(1)).alias("_every"))
    drawn = counts.join(F.broadcast(sizes), "variable").where(  # one row per column of ``cols``
        F.pmod(F.xxhash64("value"), F.col("_every")) == 0)
    cuts = drawn.groupBy("variable").agg(F.sort_array(F.collect_list(F.substring("value", 1, CUT_CHARS))).alias("_s")).select(
        "variable", F.transform(F.sequence(F.lit(1), F.lit(max(n_b - 1, 1))), lambda i: F.get(
            "_s", F.floor(i * F.size("_s") / F.lit(n_b)).cast("int"))).alias("_cuts"))
    placed = counts.join(F.broadcast(cuts), "variable", "left").withColumn(
        "_range", F.coalesce(count_below(F.col("_cuts"), F.col("value"), max(n_b - 1, 1)), F.lit(0))).drop("_cuts")
    ranges = placed.groupBy("variable", "count", "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("variable", "count").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    more = Window.partitionBy("variable").orderBy(F.col("count").desc()).rowsBetween(Window.unboundedPreceding, -1)
    higher = ranges.groupBy("variable", "count").agg(F.sum("_n").alias("_m")).select(
        "variable", "count", F.coalesce(F.sum("_m").over(more), F.lit(0)).alias("_higher"))
    start = join_on_keys(ranges, higher, ["variable", "count"]).select(
        "variable", "count", "_range", (F.col("_higher") + F.col("_before")).alias("_start"))
    own = Window.partitionBy("variable", "count", "_range").orderBy("value")
    return join_on_keys(placed.withColumn("_row", F.row_number().over(own)), start, ["variable", "count", "_range"]).select(
        "variable", "value", (F.col("_start") + F.col("_row") - 1).cast("long").alias("index"), "count")


def encode(df: DataFrame, cols: Sequence[str], how: str = "index") -> DataFrame:
    """how="index": add ``<col>_idx`` (NULL stays NULL).  how="onehot": add
    ``<col>_vec``, a sparse one-hot vector over the same index (Spark ML's
    OneHotEncoder): one slot per category, none dropped, and a last slot for
    NULL.  The mapping of all columns is computed once."""
    cols = list(cols)
    path = scratch_path(df.sparkSession, "encode")
    encode_mapping(df, cols).write.parquet(path)
    mapping = df.sparkSession.read.parquet(path)
    out = df
    for c in cols:
        m = mapping.where(F.col("variable") == c).select(F.col("value").alias(f"_v_{c}"),
                                                         F.col("index").alias(f"{c}_idx"))
        out = out.join(m, on=as_col(c).cast("string") == F.col(f"`_v_{c}`"), how="left").drop(f"_v_{c}")
    if how == "index":
        return out
    if how != "onehot":
        raise ValueError(f"unknown encoding {how!r}")
    from pyspark.ml.feature import OneHotEncoder
    # one number per column: its categories; NULL takes the slot after them
    sizes = {r["variable"]: r["n"] for r in mapping.groupBy("variable").agg((F.max("index") + 1).alias("n")).collect()}
    n = [int(sizes.get(c, 0)) for c in cols]
    tmp = out.select("*", *[F.coalesce(F.col(f"`{c}_idx`").cast("double"), F.lit(float(k))).alias(f"_i_{i}")
                            for i, (c, k) in enumerate(zip(cols, n))])
    names = [f"_i_{i}" for i in range(len(cols))]
    enc = OneHotEncoder(inputCols=names, outputCols=[f"{c}_vec" for c in cols], dropLast=False)
    widths = df.sparkSession.createDataFrame([[float(k) for k in n]], ", ".join(f"{c} double" for c in names))
    return enc.fit(widths).transform(tmp).drop(*names)
