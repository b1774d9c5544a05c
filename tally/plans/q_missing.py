"""Registered queries over tables with missing values: NULL and NaN in numbers,
NULL categories and classes (``fixtures.events_missing``)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tally.functions.stats import equal_width_bin_sql, masked_pearson_sql
from tally.operators import charts as C
from tally.operators import clean as K
from tally.operators import evaluate as M
from tally.operators import profile as P
from tally.plans.catalog import register
from tally.plans.fixtures import EVENTS_MISSING_SQL, events_missing

EM = EVENTS_MISSING_SQL


@register("v2_bar_table_missing", f"""
WITH per AS (SELECT event_type AS category, sum(value) AS value FROM {EM} AS t GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY value DESC NULLS LAST, category NULLS LAST) AS rank FROM per)
SELECT category, value, rank FROM r WHERE rank <= 3
UNION ALL SELECT '(other)', sum(value), NULL FROM r WHERE rank > 3 HAVING count(*) > 0
""", ["value"])
def v2(spark, sf):
    return C.bar_table(events_missing(spark, sf), "event_type", "value", "sum", top=3)


_BX, _BY = equal_width_bin_sql("x", "x0", "x1", 8), equal_width_bin_sql("y", "y0", "y1", 8)


@register("v3_scatter_bins_missing", f"""
WITH p AS (SELECT CAST(user_id AS DOUBLE) AS x, value AS y FROM {EM} AS t WHERE value IS NOT NULL),
l AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p),
b AS (SELECT {_BX} AS bin_x, {_BY} AS bin_y, x0, x1, y0, y1 FROM p, l)
SELECT bin_x, bin_y, x0 + (bin_x - 1) * ((x1 - x0) / 8) AS x_lo, x0 + bin_x * ((x1 - x0) / 8) AS x_hi,
       y0 + (bin_y - 1) * ((y1 - y0) / 8) AS y_lo, y0 + bin_y * ((y1 - y0) / 8) AS y_hi, count(*) AS count
FROM b GROUP BY bin_x, bin_y, x0, x1, y0, y1
""", ["x_lo", "x_hi", "y_lo", "y_hi"])
def v3(spark, sf):
    return C.scatter_table(events_missing(spark, sf), "user_id", "value", bins=8)


@register("v5_box_table_missing", f"""
WITH q AS (SELECT event_type AS category, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
                  quantile_cont(value, 0.75) AS q3 FROM {EM} AS t WHERE value IS NOT NULL GROUP BY 1),
j AS (SELECT q.*, value, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM {EM} AS t
      JOIN q ON t.event_type IS NOT DISTINCT FROM q.category WHERE value IS NOT NULL)
SELECT category, q1, median, q3, count(*) AS n, min(value) FILTER (WHERE value >= lo) AS whisker_lo,
       max(value) FILTER (WHERE value <= hi) AS whisker_hi, count(*) FILTER (WHERE value < lo OR value > hi) AS n_outliers
FROM j GROUP BY category, q1, median, q3
""", ["q1", "median", "q3", "whisker_lo", "whisker_hi"])
def v5(spark, sf):
    return C.box_table(events_missing(spark, sf), "event_type", "value")


def _mode(c: str) -> str:
    return (f"(SELECT {c} FROM {EM} AS m WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)")


@register("c3_impute_mode_missing", f"SELECT event_id, ts, user_id, coalesce(event_type, {_mode('event_type')}) AS event_type, "
          f"coalesce(value, {_mode('value')}) AS value, props FROM {EM} AS t", ["value"])
def c3(spark, sf):
    return K.impute_mode(events_missing(spark, sf), ["event_type", "value"])


_TYPES = [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"),
          ("value", "double"), ("props", "string")]


@register("d4_overview_missing", " UNION ALL ".join(
    f"SELECT '{c}' AS variable, '{t}' AS dtype, count(*) AS n_rows, count(*) FILTER (WHERE {c} IS NULL) AS n_null, "
    f"(count(*) FILTER (WHERE {c} IS NULL)) / count(*) AS null_share, count(DISTINCT {c}) AS n_distinct FROM {EM} AS t"
    for c, t in _TYPES), ["null_share"])
def d4(spark, sf):
    return P.overview(events_missing(spark, sf), exact_distinct=True)


@register("d7_correlation_missing", f"SELECT 'user_id' AS var_x, 'value' AS var_y, {masked_pearson_sql('user_id', 'value')} AS r FROM {EM} AS t",
          ["r"], digits=7)
def d7(spark, sf):
    return P.correlation(events_missing(spark, sf), ["user_id", "value"])


_D11 = f"""
WITH t AS (SELECT * FROM {EM}),
q AS (SELECT count(*) AS n, count(value) AS k, avg(value) AS mu, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM t),
m AS (SELECT avg(pow(value - mu, 2)) AS m2, avg(pow(value - mu, 3)) AS m3 FROM t, q),
c AS (SELECT event_type AS top, count(*) AS freq FROM t WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY freq DESC, top LIMIT 1)
SELECT 'missing' AS rule, 'value' AS subject, (n - k) / n AS score FROM q WHERE (n - k) / n > 0.01
UNION ALL SELECT 'missing', 'event_type', (SELECT count(*) FROM t WHERE event_type IS NULL) / n FROM q
  WHERE (SELECT count(*) FROM t WHERE event_type IS NULL) / n > 0.01
UNION ALL SELECT 'skewed', 'value', m3 / pow(m2, 1.5) FROM m WHERE abs(m3 / pow(m2, 1.5)) > 0.5
UNION ALL SELECT 'outliers', 'value', s FROM (SELECT (SELECT count(*) FROM t WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) / n
  AS s FROM q) WHERE s > 0.001
UNION ALL SELECT 'dominant_category', concat_ws('=', 'event_type', top), freq / (SELECT count(event_type) FROM t) FROM c
  WHERE freq / (SELECT count(event_type) FROM t) > 0.1
"""


@register("d11_insights_missing", _D11, ["score"])
def d11(spark, sf):
    return P.insights(events_missing(spark, sf), ["value"], ["event_type"], missing=0.01, skew=0.5, outlier_share=0.001, dominant=0.1)


_M4 = (f"WITH p AS (SELECT event_type AS label, CASE WHEN event_id % 5 = 0 THEN 'view' ELSE event_type END AS prediction FROM {EM} AS t), "
       "c AS (SELECT label, prediction, count(*) AS n FROM p GROUP BY 1, 2), "
       "k AS (SELECT label AS c FROM c UNION SELECT prediction FROM c) "
       "SELECT a.c AS label, b.c AS prediction, coalesce(c.n, 0) AS count FROM k AS a CROSS JOIN k AS b "
       "LEFT JOIN c ON c.label IS NOT DISTINCT FROM a.c AND c.prediction IS NOT DISTINCT FROM b.c")


@register("m4_confusion_matrix_missing", _M4)
def m4(spark, sf):
    e = events_missing(spark, sf)
    pred = F.when(F.col("event_id") % 5 == 0, F.lit("view")).otherwise(F.col("event_type"))
    return M.confusion_matrix(e.select(F.col("event_type").alias("label"), pred.alias("prediction")), "label", "prediction")


_HOT = (f"WITH t AS (SELECT * FROM {EM}), f AS (SELECT event_type, count(*) AS n FROM t WHERE event_type IS NOT NULL GROUP BY 1), "
        "i AS (SELECT event_type, row_number() OVER (ORDER BY n DESC, event_type) - 1 AS idx FROM f) "
        "SELECT event_id, t.event_type, coalesce(idx, (SELECT count(*) FROM f)) AS slot, (SELECT count(*) FROM f) + 1 AS slots "
        "FROM t LEFT JOIN i ON t.event_type = i.event_type")


@register("c11_encode_onehot", _HOT)
def c11(spark, sf):
    """The slot of every row's one-hot vector and the vector's width."""
    v = vector_to_array("event_type_vec")
    return K.encode(events_missing(spark, sf).select("event_id", "event_type"), ["event_type"], "onehot").select(
        "event_id", "event_type", (F.array_position(v, F.lit(1.0)) - 1).cast("long").alias("slot"), F.size(v).cast("long").alias("slots"))
