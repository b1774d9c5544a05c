"""Expression helpers shared by the operators.

All helpers return Spark ``Column`` expressions or lazy DataFrames; none of
them collects data.  The SQL twins (``*_sql``) produce the same arithmetic as
text, so an independent SQL engine can reproduce a result bit for bit.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
            T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]


def as_col(c: str | Column) -> Column:
    """A column by its exact name (names may hold dots), or the column itself."""
    return F.col(f"`{c.replace('`', '``')}`") if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    """Missing = NULL.  Spark keeps NaN apart from NULL; tables coming from
    pandas-style sources use NaN for missing, so normalise at the boundary."""
    x = as_col(c).cast("double")
    return F.when(~F.isnan(x), x)


def hash_bucket(key: Column, m: int) -> Column:
    """A bucket from 0 to m - 1 for a key of any type: the first 32 bits of
    the MD5 of the key as text, modulo ``m`` (a rule other engines have too)."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(m))


def hash_bucket_sql(key: str, m: int) -> str:
    return f"(CAST('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 8) AS BIGINT) % {m})"


# ---------------------------------------------------------------------------
# Rounding to significant digits, identical in Spark and in SQL.
#
# Aggregates computed in a different order differ in the last bits.  Results
# are compared after rounding to ``digits`` significant digits; values below
# 1e-9 in magnitude count as zero.  Powers of ten are only ever used with a
# non-negative exponent, where they are exact doubles, so both engines perform
# the same IEEE operations and round half away from zero.
# ---------------------------------------------------------------------------

def rsig(c: str | Column, digits: int = 9) -> Column:
    x = as_col(c).cast("double")
    s = F.lit(digits - 1) - F.floor(F.log10(F.abs(x)))
    p = F.pow(F.lit(10.0), F.abs(s))  # exact: integer exponent <= 22
    m = F.when(s >= 0, x * p).otherwise(x / p)
    r = F.signum(m) * F.floor(F.abs(m) + 0.5)  # half away from zero, no BigDecimal
    return (F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), x)
            .when(F.abs(x) < 1e-9, F.lit(0.0))
            .when(s >= 0, r / p)
            .otherwise(r * p))


def rsig_sql(expr: str, digits: int = 9) -> str:
    x = f"CAST(({expr}) AS DOUBLE)"
    s = f"({digits - 1} - floor(log10(abs({x}))))"
    p = f"pow(10.0, abs({s}))"
    m = f"(CASE WHEN {s} >= 0 THEN {x} * {p} ELSE {x} / {p} END)"
    r = f"(sign({m}) * floor(abs({m}) + 0.5))"
    return (f"CASE WHEN {x} IS NULL OR isnan({x}) OR isinf({x}) THEN {x} "
            f"WHEN abs({x}) < 1e-9 THEN 0.0 "
            f"WHEN {s} >= 0 THEN {r} / {p} ELSE {r} * {p} END")


def finalize(df: DataFrame, digits: int = 9) -> DataFrame:
    """Round every floating-point column to ``digits`` significant digits.

    Same arithmetic as :func:`rsig`, staged over three projections so each
    intermediate (exponent, scale, scaled value) is computed once per row
    instead of being re-inlined into every CASE branch."""
    fl = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not fl:
        return df
    names = df.columns
    idx = {c: i for i, c in enumerate(names)}
    keep = [F.col(f"`{c}`") for c in names if c not in fl]
    st1 = df.select(*keep, *[F.col(f"`{c}`").cast("double").alias(f"_x{idx[c]}") for c in fl])
    st1 = st1.select("*", *[(F.lit(digits - 1) - F.floor(F.log10(F.abs(F.col(f"_x{idx[c]}"))))).alias(f"_s{idx[c]}")
                            for c in fl])
    st2 = st1.select("*", *[F.pow(F.lit(10.0), F.abs(F.col(f"_s{idx[c]}"))).alias(f"_p{idx[c]}") for c in fl])
    st3 = st2.select("*", *[F.when(F.col(f"_s{idx[c]}") >= 0, F.col(f"_x{idx[c]}") * F.col(f"_p{idx[c]}"))
                            .otherwise(F.col(f"_x{idx[c]}") / F.col(f"_p{idx[c]}")).alias(f"_m{idx[c]}") for c in fl])

    def out(c):
        i = idx[c]
        x, s_, p_, m_ = (F.col(f"_{k}{i}") for k in "xspm")
        r = F.signum(m_) * F.floor(F.abs(m_) + 0.5)
        return (F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), x)
                .when(F.abs(x) < 1e-9, F.lit(0.0))
                .when(s_ >= 0, r / p_).otherwise(r * p_)).alias(c)

    return st3.select(*[out(c) if c in fl else F.col(f"`{c}`") for c in names])


def finalize_sql(sql: str, double_cols: Sequence[str], digits: int = 9) -> str:
    """SQL twin of :func:`finalize`: wrap a query, rounding the listed columns."""
    if not double_cols:
        return sql
    repl = ", ".join(f"{rsig_sql(f'q.\"{c}\"', digits)} AS \"{c}\"" for c in double_cols)
    return f"SELECT * REPLACE ({repl}) FROM ({sql}) AS q"


# ---------------------------------------------------------------------------
# Guarded statistics
# ---------------------------------------------------------------------------

def masked_pearson(x: str | Column, y: str | Column) -> Column:
    """Pairwise-complete Pearson r that is NULL (not an error) on a constant.

    ``corr`` raises DIVIDE_BY_ZERO under ANSI on a constant column, and the
    error cannot be caught by a CASE around the aggregate.  Both inputs are
    masked to the rows where the other one is present, so NULLs in different
    rows give the pairwise-complete value.
    """
    x, y = as_col(x).cast("double"), as_col(y).cast("double")
    xm = F.when(y.isNotNull(), x)
    ym = F.when(x.isNotNull(), y)
    den = F.stddev_pop(xm) * F.stddev_pop(ym)
    return F.covar_pop(xm, ym) / F.when(den != 0, den)


def masked_pearson_sql(x: str, y: str) -> str:
    xm = f"CASE WHEN ({y}) IS NOT NULL THEN CAST(({x}) AS DOUBLE) END"
    ym = f"CASE WHEN ({x}) IS NOT NULL THEN CAST(({y}) AS DOUBLE) END"
    return f"covar_pop({xm}, {ym}) / nullif(stddev_pop({xm}) * stddev_pop({ym}), 0)"


def equal_width_bin(v: Column, lo: Column, hi: Column, n: int) -> Column:
    """1-based equal-width bin; the last bin is closed on the right, and a
    constant column falls in bin 1 (``width_bucket`` gives n+1 and NULL)."""
    return (F.when(v.isNull(), F.lit(None).cast("long"))
            .when(hi == lo, F.lit(1).cast("long"))
            .otherwise(F.least(F.floor((v - lo) / (hi - lo) * F.lit(n)) + 1, F.lit(n).cast("long"))))


def equal_width_bin_sql(v: str, lo: str, hi: str, n: int) -> str:
    return (f"CASE WHEN ({v}) IS NULL THEN NULL WHEN ({hi}) = ({lo}) THEN 1 "
            f"ELSE least(CAST(floor((({v}) - ({lo})) / (({hi}) - ({lo})) * {n}) AS BIGINT) + 1, {n}) END")


# ---------------------------------------------------------------------------
# Running sums without a single-partition window
# ---------------------------------------------------------------------------

def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with NULL-safe equality, keeping one copy of the keys."""
    r = right.select(*[F.col(k).alias(f"_rk_{k}") for k in keys],
                     *[F.col(c) for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_rk_{k}"))
        cond = c if cond is None else cond & c
    return left.join(r, on=cond, how=how).drop(*[f"_rk_{k}" for k in keys])


def bucket_count(df: DataFrame, buckets: int | None) -> int:
    if buckets:
        return max(int(buckets), 1)
    try:
        return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    except Exception:  # pragma: no cover - conf always present in practice
        return 8


def count_below(cuts: Column, v: Column, n: int) -> Column:
    """Number of the ``n`` entries of the sorted array ``cuts`` below ``v``, by
    binary search: the expression has the same size for any ``n``."""
    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        below = F.coalesce(F.get(cuts, mid) < v, F.lit(False))
        done = acc["lo"] >= acc["hi"]
        return F.struct(F.when(done | ~below, acc["lo"]).otherwise(mid + 1).alias("lo"),
                        F.when(done | below, acc["hi"]).otherwise(mid).alias("hi"))
    start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(n.bit_length())), start, step, lambda acc: acc["lo"])


def running_sums(df: DataFrame, order_col: str, sum_cols: Sequence[str],
                 by: Iterable[str] = (), descending: bool = False,
                 buckets: int | None = None, prefix: str = "cum_",
                 unique_order: bool = False) -> DataFrame:
    """Inclusive running sums of ``sum_cols`` along ``order_col`` (rows with
    equal order values share one value), per ``by`` group.

    ``sum(...) over (order by x)`` without a partition key plans an
    ``Exchange SinglePartition``: one task would hold every row.  Instead the
    order axis is cut into ``buckets`` ranges at approximate quantiles (one
    bounded aggregate), each range gets its total (one shuffle, partial
    aggregation), the totals get their prefix (a window over buckets x groups
    rows), and the final window runs per (group, range).  Typical input is
    already aggregated to one row per order value, so a hot value is one row.
    ``order_col`` must be numeric, date or timestamp and not NULL.
    ``unique_order=True`` states that ``order_col`` is unique within each
    group (the input is aggregated by it), which allows a ROWS frame.
    """
    by = list(by)
    n_b = bucket_count(df, buckets)
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()

    def frame(w):
        return (w.rowsBetween(Window.unboundedPreceding, 0) if unique_order
                else w.rangeBetween(Window.unboundedPreceding, 0))

    if n_b == 1:
        w = frame(Window.partitionBy(*by).orderBy(order))
        return df.select("*", *[F.sum(c).over(w).alias(f"{prefix}{c}") for c in sum_cols])

    probs = [i / n_b for i in range(1, n_b)]
    pa = F.percentile_approx(F.col(order_col), probs, 10000).alias("_cuts")
    if by:
        # cut points per group (one row per group: AQE broadcasts when small)
        cuts = df.groupBy(*by).agg(pa)
        x = join_on_keys(df, cuts, by)
    else:
        # one row: broadcasting it is bounded by construction
        x = df.crossJoin(F.broadcast(df.agg(pa)))
    x = x.withColumn("_bkt", count_below(F.col("_cuts"), F.col(order_col), n_b - 1)).drop("_cuts")
    # running sum inside each (group, range): the shuffle is by (group, range)
    wi = frame(Window.partitionBy(*by, "_bkt").orderBy(order))
    xw = x.select("*", *[F.sum(c).over(wi).alias(f"_w_{c}") for c in sum_cols])
    # plus the total of all earlier ranges of the group
    tot = x.groupBy(*by, "_bkt").agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    bkt_order = F.col("_bkt").desc() if descending else F.col("_bkt").asc()
    wb = Window.partitionBy(*by).orderBy(bkt_order).rowsBetween(Window.unboundedPreceding, -1)
    pre = tot.select(*by, "_bkt", *[F.coalesce(F.sum(f"_t_{c}").over(wb), F.lit(0)).alias(f"_p_{c}")
                                    for c in sum_cols])
    # ``pre`` has at most groups x buckets rows; AQE turns this into a
    # broadcast join when its measured size is small, a shuffle join otherwise.
    y = join_on_keys(xw, pre, [*by, "_bkt"])
    return y.select(*[F.col(f"`{c}`") for c in df.columns],
                    *[(F.col(f"_p_{c}") + F.col(f"_w_{c}")).alias(f"{prefix}{c}") for c in sum_cols])


# ---------------------------------------------------------------------------
# Exact quantiles without a per-group value map
# ---------------------------------------------------------------------------

def quantiles(df: DataFrame, col: str | Column, probs: Sequence[float], by: Sequence[str] = (),
              buckets: int | None = None, out: str = "_q") -> DataFrame:
    """Exact quantiles with linear interpolation (position p (n - 1), as
    ``percentile`` / ``quantile_cont``): one row per ``by`` group holding the
    array ``out`` in ``probs`` order.  NaN counts as missing.

    ``percentile`` keeps a map of every distinct value of a group in one
    aggregation buffer, so a global percentile over a continuous column
    lands in a single task.  Here the values are counted by a grouped
    aggregate (partial aggregation), ranked by bucketed running counts, and
    only the rows holding the wanted order statistics (two per quantile)
    survive the range match against the small target table.  The plan is the
    same at every size and needs no job before it.
    """
    by = list(by)
    v = df.select(*by, nan_to_null(as_col(col)).alias("_v")).where(F.col("_v").isNotNull())
    counts = v.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    cum = running_sums(counts, "_v", ["_n"], by=by, buckets=buckets, unique_order=True)
    tot = counts.groupBy(*by).agg(F.sum("_n").alias("_N"))
    tgt = (tot.select(*by, "_N", F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("_i", "_p"))
           .select(*by, "_i", (F.col("_p") * (F.col("_N") - 1)).alias("_h"), "_N"))
    tgt = tgt.select(*by, "_i", "_h", F.floor("_h").alias("_lo"),
                     F.least(F.floor("_h") + 1, F.col("_N") - 1).alias("_hi"))
    before = F.col("cum__n") - F.col("_n")
    has_lo = (before <= F.col("_lo")) & (F.col("_lo") < F.col("cum__n"))
    has_hi = (before <= F.col("_hi")) & (F.col("_hi") < F.col("cum__n"))
    if by:
        m = join_on_keys(cum, tgt, by).where(has_lo | has_hi)
    else:
        # the target table has len(probs) rows
        m = cum.crossJoin(F.broadcast(tgt)).where(has_lo | has_hi)
    g = m.groupBy(*by, "_i", "_h", "_lo").agg(F.max(F.when(has_lo, F.col("_v"))).alias("_a"),
                                              F.max(F.when(has_hi, F.col("_v"))).alias("_b"))
    val = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_h") - F.col("_lo"))
    res = g.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col("_i"), val.alias("_x")))).alias("_s"))
    return res.select(*by, F.col("_s._x").alias(out))


def run_parallel(fn, items: Sequence, parallelism: int = 4) -> list:
    """``[fn(x) for x in items]`` with up to ``parallelism`` concurrent Spark
    jobs submitted from driver threads (as Spark ML's CrossValidator does);
    thread-local job properties are inherited."""
    from multiprocessing.pool import ThreadPool

    from pyspark.util import inheritable_thread_target
    items = list(items)
    if parallelism <= 1 or len(items) <= 1:
        return [fn(x) for x in items]
    with ThreadPool(min(parallelism, len(items))) as pool:
        return pool.map(inheritable_thread_target(fn), items)


# ---------------------------------------------------------------------------
# Pair moments: all correlations of many columns in one pass
# ---------------------------------------------------------------------------

def pair_moments(df: DataFrame, vector: str, k: int) -> DataFrame:
    """``(i, j, n, cxx, cyy, cxy)`` for every pair i <= j of the ``k`` entries
    of the array column ``vector``: the rows where both are present, and the
    centred sums over them.

    One scan: every Arrow batch contributes masked matrix products (k x k
    values, whatever its rows), which merge into the batch totals of a task
    around the task's own means; tasks are merged by a grouped sum of their
    totals, corrected for the distance of their means from the overall mean,
    so large offsets do not cancel.  The plan does not depend on ``k``.
    """
    import numpy as np
    import pyarrow as pa

    rows_i, rows_j = np.triu_indices(k)

    def run(batches):
        total = None
        for b in batches:
            col = b.column(0)
            x = np.asarray(col.flatten().to_numpy(zero_copy_only=False), dtype="float64").reshape(-1, k)
            if not len(x):
                continue
            mask = ~np.isnan(x)
            if total is None:
                shift = np.where(mask.any(0), np.where(mask, x, 0.0).sum(0) / np.maximum(mask.sum(0), 1), 0.0)
                total = [np.zeros((k, k)) for _ in range(6)]
            z = np.where(mask, x - shift, 0.0)
            m = mask.astype("float64")
            zz = z * z
            for t, part in zip(total, (m.T @ m, z.T @ m, m.T @ z, zz.T @ m, m.T @ zz, z.T @ z)):
                t += part
        if total is None:
            return
        n, sx, sy, sxx, syy, sxy = (t[rows_i, rows_j] for t in total)
        d = np.maximum(n, 1)
        mx, my = sx / d, sy / d
        cols = [pa.array(rows_i, pa.int32()), pa.array(rows_j, pa.int32()), pa.array(n.astype("int64")),
                pa.array(mx + shift[rows_i]), pa.array(my + shift[rows_j]),
                pa.array(sxx - n * mx * mx), pa.array(syy - n * my * my), pa.array(sxy - n * mx * my)]
        yield pa.RecordBatch.from_arrays(cols, names=["i", "j", "n", "mx", "my", "cxx", "cyy", "cxy"])

    parts = df.select(vector).mapInArrow(
        run, "i int, j int, n long, mx double, my double, cxx double, cyy double, cxy double").where("n > 0")
    w = Window.partitionBy("i", "j")
    dx = F.col("mx") - F.sum(F.col("n") * F.col("mx")).over(w) / F.sum("n").over(w)
    dy = F.col("my") - F.sum(F.col("n") * F.col("my")).over(w) / F.sum("n").over(w)
    parts = parts.select("*", dx.alias("dx"), dy.alias("dy"))
    return parts.groupBy("i", "j").agg(
        F.sum("n").alias("n"), F.sum(F.col("cxx") + F.col("n") * F.col("dx") * F.col("dx")).alias("cxx"),
        F.sum(F.col("cyy") + F.col("n") * F.col("dy") * F.col("dy")).alias("cyy"),
        F.sum(F.col("cxy") + F.col("n") * F.col("dx") * F.col("dy")).alias("cxy"))
