"""Registered queries D1-D11 (profile, distribution, correlation, dashboard)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tally.functions.stats import masked_pearson_sql
from tally.operators import profile as P
from tally.operators import sketches as K
from tally.plans.catalog import register
from tally.plans.fixtures import EVENTS_NULLS_SQL, events_nulls
from tally.plans.q_charts import thinned_sql
from tally.session import written
from tally.sources.files import read_table

LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _d(c: str) -> str:
    return f"CAST({c} AS DOUBLE)"


# --------------------------------------------------------------------- D1
_D1_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS variable, count({_d(c)}) AS count, avg({_d(c)}) AS mean, "
    f"stddev_samp({_d(c)}) AS std, min({_d(c)}) AS min, quantile_cont({_d(c)}, 0.25) AS p25, "
    f"quantile_cont({_d(c)}, 0.5) AS p50, quantile_cont({_d(c)}, 0.75) AS p75, max({_d(c)}) AS max "
    f"FROM lineitem" for c in LI_NUM)


@register("d1_describe_numeric", _D1_SQL, ["mean", "std", "min", "p25", "p50", "p75", "max"])
def d1(spark, sf):
    return P.describe_numeric(read_table(spark, sf, "lineitem"), LI_NUM)


@register("d1_describe_numeric_approx")
def d1_approx(spark, sf):
    # sketch-based quartiles: bounded memory for any number of distinct values
    return P.describe_numeric(read_table(spark, sf, "lineitem"), LI_NUM, exact=False)


# --------------------------------------------------------------------- D2
_D2_SQL = """
WITH long AS (
  SELECT 'o_orderstatus' AS variable, CAST(o_orderstatus AS VARCHAR) AS value FROM orders
  UNION ALL SELECT 'o_orderpriority', CAST(o_orderpriority AS VARCHAR) FROM orders
  UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders),
c AS (SELECT variable, value, count(*) AS n FROM long GROUP BY variable, value),
s AS (SELECT variable, CAST(coalesce(sum(CASE WHEN value IS NOT NULL THEN n END), 0) AS BIGINT) AS count,
             count(value) AS unique FROM c GROUP BY variable),
t AS (SELECT variable, value AS top, n AS freq FROM (
        SELECT *, row_number() OVER (PARTITION BY variable ORDER BY n DESC, value) AS rn
        FROM c WHERE value IS NOT NULL) WHERE rn = 1)
SELECT s.variable, s.count, s.unique, t.top, t.freq FROM s LEFT JOIN t USING (variable)
"""


@register("d2_describe_categorical", _D2_SQL)
def d2(spark, sf):
    return P.describe_categorical(read_table(spark, sf, "orders"),
                                  ["o_orderstatus", "o_orderpriority", "o_custkey"])


# --------------------------------------------------------------------- D3
_D3_SQL = """
SELECT o_orderpriority, count(*) AS count, count(*) / sum(count(*)) OVER () AS share
FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority
"""


@register("d3_value_counts", _D3_SQL, ["share"])
def d3(spark, sf):
    return P.value_counts(read_table(spark, sf, "orders"), "o_orderpriority")


# --------------------------------------------------------------------- D4
_EV_TYPES = [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"),
             ("event_type", "string"), ("value", "double"), ("props", "string")]
_D4_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS variable, '{t}' AS dtype, count(*) AS n_rows, "
    f"count(*) FILTER (WHERE {c} IS NULL) AS n_null, "
    f"(count(*) FILTER (WHERE {c} IS NULL)) / count(*) AS null_share, "
    f"count(DISTINCT {c}) AS n_distinct FROM {EVENTS_NULLS_SQL} AS t" for c, t in _EV_TYPES)


@register("d4_overview", _D4_SQL, ["null_share"])
def d4(spark, sf):
    return P.overview(events_nulls(spark, sf), exact_distinct=True)


@register("d4_overview_approx")
def d4_approx(spark, sf):
    return P.overview(read_table(spark, sf, "lineitem"), exact_distinct=False)


# --------------------------------------------------------------------- D5
def _moments_sql(col: str, src: str) -> str:
    return (f"(SELECT count({col}) AS n, avg({col}) AS mean, stddev_samp({col}) AS std, "
            f"min({col}) AS min, max({col}) AS max, "
            f"avg(pow({col} - (SELECT avg({col}) FROM {src}), 2)) AS m2, "
            f"avg(pow({col} - (SELECT avg({col}) FROM {src}), 3)) AS m3, "
            f"avg(pow({col} - (SELECT avg({col}) FROM {src}), 4)) AS m4 FROM {src})")


_PCTS = [("p01", 0.01), ("p05", 0.05), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95),
         ("p99", 0.99)]
_D5_SQL = (
    "SELECT 'value' AS variable, m.n, m.mean, m.std, m.m3 / pow(m.m2, 1.5) AS skewness, "
    "m.m3 / pow(m.m2, 1.5) * sqrt(m.n * (m.n - 1.0)) / (m.n - 2.0) AS skewness_adj, "
    "m.m4 / (m.m2 * m.m2) - 3.0 AS kurtosis, m.min, "
    + ", ".join(f"(SELECT quantile_cont(value, {p}) FROM events) AS {a}" for a, p in _PCTS)
    + ", m.max FROM " + _moments_sql("value", "events") + " AS m")


@register("d5_distribution", _D5_SQL,
          ["mean", "std", "skewness", "skewness_adj", "kurtosis", "min", "max"] + [a for a, _ in _PCTS])
def d5(spark, sf):
    return P.distribution(read_table(spark, sf, "events"), "value")


_D5E_SQL = """
SELECT value, count(*) AS count,
       CAST(sum(count(*)) OVER (ORDER BY value) AS BIGINT) AS cum_count,
       sum(count(*)) OVER (ORDER BY value) / sum(count(*)) OVER () AS ecdf
FROM events WHERE value IS NOT NULL GROUP BY value
"""


@register("d5_ecdf", _D5E_SQL, ["value", "ecdf"])
def d5_ecdf(spark, sf):
    return P.ecdf(read_table(spark, sf, "events"), "value")


@register("d5_ecdf_bounded", thinned_sql(_D5E_SQL, "value", "value", ["ecdf"], 200, "value, count, cum_count, ecdf"), ["value", "ecdf"])
def d5_ecdf_bounded(spark, sf):
    return P.ecdf(read_table(spark, sf, "events"), "value", max_points=200)


# --------------------------------------------------------------------- D6
_D6_SQL = (
    "SELECT 'value' AS variable, m.n, m.m3 / pow(m.m2, 1.5) AS skewness, m.m4 / (m.m2 * m.m2) - 3.0 AS kurtosis, "
    "m.n / 6.0 * (pow(m.m3 / pow(m.m2, 1.5), 2) + pow(m.m4 / (m.m2 * m.m2) - 3.0, 2) / 4.0) AS jb, "
    "exp(-(m.n / 6.0 * (pow(m.m3 / pow(m.m2, 1.5), 2) + pow(m.m4 / (m.m2 * m.m2) - 3.0, 2) / 4.0)) / 2.0) "
    "AS p_value FROM " + _moments_sql("value", "events") + " AS m")


@register("d6_normality", _D6_SQL, ["skewness", "kurtosis", "jb", "p_value"])
def d6(spark, sf):
    return P.normality(read_table(spark, sf, "events"), "value")


@register("d6_ks_normal")
def d6_ks(spark, sf):
    return P.ks_normal(read_table(spark, sf, "events"), "value")


# ------------------------------------------------------------------ D7-D9
_PAIRS = [(a, b) for i, a in enumerate(LI_NUM) for b in LI_NUM[i + 1:]]
_D7_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS var_x, '{b}' AS var_y, {masked_pearson_sql(a, b)} AS r FROM lineitem" for a, b in _PAIRS)


@register("d7_correlation", _D7_SQL, ["r"])
def d7(spark, sf):
    return P.correlation(read_table(spark, sf, "lineitem"), LI_NUM)


_RANKS = ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in LI_NUM)
_D8_SQL = (
    f"WITH b AS (SELECT {', '.join(LI_NUM)} FROM lineitem WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in LI_NUM)
    + f"), r AS (SELECT {_RANKS} FROM b) "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS var_x, '{b}' AS var_y, {masked_pearson_sql(a, b)} AS r FROM r" for a, b in _PAIRS))


@register("d8_spearman", _D8_SQL, ["r"])
def d8(spark, sf):
    return P.correlation(read_table(spark, sf, "lineitem"), LI_NUM, method="spearman")


_D9_SQL = " UNION ALL ".join(
    [f"SELECT '{a}' AS var_x, '{b}' AS var_y, {masked_pearson_sql(a, b)} AS r FROM lineitem" for a, b in _PAIRS]
    + [f"SELECT '{b}' AS var_x, '{a}' AS var_y, {masked_pearson_sql(a, b)} AS r FROM lineitem" for a, b in _PAIRS]
    + [f"SELECT '{c}' AS var_x, '{c}' AS var_y, CASE WHEN stddev_pop({c}) > 0 THEN 1.0 END AS r FROM lineitem"
       for c in LI_NUM])


@register("d9_heatmap", _D9_SQL, ["r"])
def d9(spark, sf):
    return P.heatmap(read_table(spark, sf, "lineitem"), LI_NUM)


# -------------------------------------------------------------------- D10
_D10_METRICS = [("n_orders", "CAST(count(*) AS DOUBLE)"), ("revenue", "sum(o_totalprice)"),
                ("avg_order", "avg(o_totalprice)"), ("n_customers", "CAST(count(DISTINCT o_custkey) AS DOUBLE)")]
_D10_SQL = (
    "WITH per AS (SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS p, "
    + ", ".join(f"{e} AS m{i}" for i, (_, e) in enumerate(_D10_METRICS))
    + " FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p DESC) AS rn FROM per), "
    "long AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, p, rn, m{i} AS v FROM r WHERE rn <= 2"
                                     for i, (m, _) in enumerate(_D10_METRICS)) + "), "
    "agg AS (SELECT metric, max(CASE WHEN rn = 1 THEN p END) AS period, max(CASE WHEN rn = 1 THEN v END) AS value, "
    "max(CASE WHEN rn = 2 THEN v END) AS previous FROM long GROUP BY metric) "
    "SELECT metric, period, value, previous, value - previous AS delta, "
    "CASE WHEN previous <> 0 THEN (value - previous) / previous END AS delta_pct FROM agg")


@register("d10_metric_cards", _D10_SQL, ["value", "previous", "delta", "delta_pct"])
def d10(spark, sf):
    o = read_table(spark, sf, "orders")
    metrics = {"n_orders": F.count(F.lit(1)), "revenue": F.sum("o_totalprice"),
               "avg_order": F.avg("o_totalprice"), "n_customers": F.count_distinct("o_custkey")}
    return P.metric_cards(o, metrics, period=F.date_trunc("month", "o_orderdate").cast("timestamp_ntz"))


_D10T_SQL = " UNION ALL ".join(f"SELECT '{m}' AS metric, {e} AS value FROM orders" for m, e in _D10_METRICS)


@register("d10_metric_cards_total", _D10T_SQL, ["value"])
def d10_total(spark, sf):
    o = read_table(spark, sf, "orders")
    metrics = {"n_orders": F.count(F.lit(1)), "revenue": F.sum("o_totalprice"),
               "avg_order": F.avg("o_totalprice"), "n_customers": F.count_distinct("o_custkey")}
    return P.metric_cards(o, metrics)


# -------------------------------------------------------------------- D11
def _d11_sql() -> str:
    t = EVENTS_NULLS_SQL
    num = ["value", "user_id"]
    allc = num + ["event_type"]
    mom = ", ".join(
        f"avg(pow(CAST({c} AS DOUBLE) - (SELECT avg(CAST({c} AS DOUBLE)) FROM {t} AS u), {k})) AS m{k}_{c}"
        for c in num for k in (2, 3))
    one = (f"SELECT count(*) AS n_rows, "
           + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS null_{c}" for c in allc) + ", "
           + ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1_{c}, "
                       f"quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3_{c}" for c in num) + ", "
           + f"{masked_pearson_sql('value', 'user_id')} AS r0, " + mom + f" FROM {t} AS t")
    parts = [f"SELECT 'missing' AS rule, '{c}' AS subject, null_{c} / n_rows AS score FROM one "
             f"WHERE null_{c} / n_rows > 0.05" for c in allc]
    parts += [f"SELECT 'skewed', '{c}', m3_{c} / pow(m2_{c}, 1.5) FROM one "
              f"WHERE abs(m3_{c} / pow(m2_{c}, 1.5)) > 1.0" for c in num]
    parts += ["SELECT 'correlated', 'value~user_id', r0 FROM one WHERE abs(r0) > 0.7"]
    parts += [f"SELECT 'outliers', '{c}', s FROM (SELECT count(*) FILTER (WHERE {c} < q1_{c} - 1.5 * (q3_{c} - q1_{c}) "
              f"OR {c} > q3_{c} + 1.5 * (q3_{c} - q1_{c})) / count(*) AS s FROM {t} AS t, one) WHERE s > 0.01"
              for c in num]
    parts += [f"SELECT 'dominant_category', concat_ws('=', 'event_type', top), freq / cnt FROM ("
              f"SELECT (SELECT count(event_type) FROM {t} AS a) AS cnt, event_type AS top, count(*) AS freq "
              f"FROM {t} AS b WHERE event_type IS NOT NULL GROUP BY event_type ORDER BY freq DESC, top LIMIT 1) "
              f"WHERE freq / cnt > 0.5"]
    return f"WITH one AS ({one}) " + " UNION ALL ".join(parts)


@register("d11_insights", _d11_sql(), ["score"])
def d11(spark, sf):
    return P.insights(events_nulls(spark, sf), ["value", "user_id"], ["event_type"])


# ------------------------------------------------ D1 D2 D4 from merged states
_MERGED = ("SELECT '{c}' AS variable, count({c}) AS count, CAST(count(*) - count({c}) AS BIGINT) AS n_null, avg({c}) AS mean, stddev_samp({c}) AS std, "
           "min({c}) AS min, max({c}) AS max, true AS quantiles_close, true AS distinct_close FROM lineitem")


@register("d1_merged_profile", " UNION ALL ".join(_MERGED.format(c=c) for c in ("l_quantity", "l_extendedprice", "l_discount")),
          ["mean", "std", "min", "max"])
def d1_merged(spark, sf):
    """A state per ship year, merged; the sketches' answers are held against the rows."""
    cols, li = ["l_quantity", "l_extendedprice", "l_discount"], read_table(spark, sf, "lineitem")
    states = written(K.numeric_state(li.withColumn("year", F.year("l_shipdate")), cols, ["year"]), "profile-states")
    found = written(K.numeric_profile(states), "profile")
    wide = li.select(F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("v")) for c in cols])))
    held = wide.join(F.broadcast(found.select("variable", "p25", "p50", "p75")), "variable").groupBy("variable").agg(
        *[F.avg((F.col("v") < F.col(p)).cast("double")).alias(f"below_{p}") for p in ("p25", "p50", "p75")],
        *[F.avg((F.col("v") <= F.col(p)).cast("double")).alias(f"upto_{p}") for p in ("p25", "p50", "p75")],
        F.count_distinct("v").alias("distinct"))
    close = F.lit(True)
    for p, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
        close = close & (F.col(f"below_{p}") <= q + 0.03) & (F.col(f"upto_{p}") >= q - 0.03)
    return found.join(held, "variable").select(
        "variable", "count", "n_null", "mean", "std", "min", "max", close.alias("quantiles_close"),
        (F.abs(F.col("n_distinct") / F.col("distinct") - 1) < 0.08).alias("distinct_close"))


@register("d2_merged_top", " UNION ALL ".join(
    f"SELECT '{c}' AS variable, value, n AS count FROM (SELECT {c} AS value, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, value LIMIT 3)"
    for c in ("o_orderpriority", "o_orderstatus")))
def d2_merged(spark, sf):
    o = read_table(spark, sf, "orders")
    states = written(K.categorical_state(o.withColumn("year", F.year("o_orderdate")), ["o_orderpriority", "o_orderstatus"], ["year"]), "profile-states")
    return K.categorical_profile(states, 3).select("variable", F.inline("top"))
