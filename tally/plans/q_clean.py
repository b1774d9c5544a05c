"""Registered queries C1-C11 (preprocessing)."""

from __future__ import annotations

from tally.operators import clean as K
from tally.plans.catalog import register
from tally.plans.fixtures import EVENTS_NULLS_SQL as EN
from tally.plans.fixtures import ORDERS_TEXT_SQL as OT
from tally.plans.fixtures import events_nulls, orders_text
from tally.sources.files import read_table

_EV = "event_id, ts, user_id, event_type, value, props"


# --------------------------------------------------------------------- C1
@register("c1_drop_missing", f"SELECT {_EV} FROM {EN} AS t WHERE event_id IS NOT NULL AND ts IS NOT NULL AND "
                             "user_id IS NOT NULL AND event_type IS NOT NULL AND value IS NOT NULL AND "
                             "props IS NOT NULL", ["value"])
def c1(spark, sf):
    return K.drop_missing(events_nulls(spark, sf))


# --------------------------------------------------------------------- C2
@register("c2_impute_mean", f"SELECT event_id, ts, user_id, event_type, "
                            f"coalesce(value, (SELECT avg(value) FROM {EN} AS u)) AS value, props FROM {EN} AS t",
          ["value"])
def c2(spark, sf):
    return K.impute_mean(events_nulls(spark, sf), ["value"])


@register("c2_impute_mean_by", f"SELECT l.event_id, l.ts, l.user_id, l.event_type, coalesce(l.value, m.mv) AS value, "
                               f"l.props FROM {EN} AS l LEFT JOIN (SELECT event_type, avg(value) AS mv FROM {EN} AS u "
                               "GROUP BY event_type) AS m ON l.event_type IS NOT DISTINCT FROM m.event_type",
          ["value"])
def c2_by(spark, sf):
    return K.impute_mean(events_nulls(spark, sf), ["value"], by=["event_type"])


# --------------------------------------------------------------------- C3
_MODE = ("(SELECT {c} FROM {t} AS u WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)")


@register("c3_impute_mode", f"SELECT event_id, ts, user_id, "
                            f"coalesce(event_type, {_MODE.format(c='event_type', t=EN)}) AS event_type, "
                            f"coalesce(value, {_MODE.format(c='value', t=EN)}) AS value, props FROM {EN} AS t",
          ["value"])
def c3(spark, sf):
    return K.impute_mode(events_nulls(spark, sf), ["event_type", "value"])


# ------------------------------------------------------------------ C4 C5
_IQR = "(SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)"
_IQR_OUT = "coalesce(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1), false)"


@register("c4_flag_outliers_iqr", f"SELECT {_EV}, {_IQR_OUT} AS is_outlier FROM events, {_IQR} AS s", ["value"])
def c4_iqr(spark, sf):
    return K.flag_outliers(read_table(spark, sf, "events"), "value", "iqr")


@register("c4_flag_outliers_zscore",
          f"SELECT {_EV}, coalesce(abs(value - mu) / sd > 3.0, false) AS is_outlier FROM events, "
          "(SELECT avg(value) AS mu, stddev_samp(value) AS sd FROM events) AS s", ["value"])
def c4_z(spark, sf):
    return K.flag_outliers(read_table(spark, sf, "events"), "value", "zscore")


@register("c4_flag_outliers_joint", """
WITH s AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my, var_samp(l_quantity) AS sxx, var_samp(l_extendedprice) AS syy,
                  covar_samp(l_quantity, l_extendedprice) AS sxy FROM lineitem),
d AS (SELECT l_orderkey, l_linenumber, l_quantity - mx AS x, l_extendedprice - my AS y, sxx, syy, sxy FROM lineitem, s),
m AS (SELECT l_orderkey, l_linenumber, (syy * x * x - 2 * sxy * x * y + sxx * y * y) / (sxx * syy - sxy * sxy) AS mahalanobis2 FROM d)
SELECT *, mahalanobis2 > 5.5 AS is_outlier FROM m
""", ["mahalanobis2"], digits=6)
def c4_joint(spark, sf):
    found = K.flag_outliers_joint(read_table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], limit=5.5)
    return found.select("l_orderkey", "l_linenumber", "mahalanobis2", "is_outlier")


@register("c4_flag_outliers_iqr_by",
          "SELECT e.event_id, e.ts, e.user_id, e.event_type, e.value, e.props, "
          "coalesce(e.value < q1 - 1.5 * (q3 - q1) OR e.value > q3 + 1.5 * (q3 - q1), false) AS is_outlier "
          "FROM events AS e LEFT JOIN (SELECT event_type, quantile_cont(value, 0.25) AS q1, "
          "quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type) AS s "
          "ON e.event_type IS NOT DISTINCT FROM s.event_type", ["value"])
def c4_by(spark, sf):
    return K.flag_outliers(read_table(spark, sf, "events"), "value", "iqr", by=["event_type"])


@register("c5_drop_outliers", f"SELECT {_EV} FROM events, {_IQR} AS s WHERE NOT {_IQR_OUT}", ["value"])
def c5(spark, sf):
    return K.drop_outliers(read_table(spark, sf, "events"), "value", "iqr")


# ------------------------------------------------------------------ C6 C7
_TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "double", "o_orderdate": "timestamp_ntz"}


@register("c6_convert_types", "SELECT TRY_CAST(o_orderkey AS BIGINT) AS o_orderkey, "
                              "TRY_CAST(o_custkey AS BIGINT) AS o_custkey, o_orderstatus, "
                              "TRY_CAST(o_totalprice AS DOUBLE) AS o_totalprice, "
                              f"TRY_CAST(o_orderdate AS TIMESTAMP) AS o_orderdate, o_orderpriority FROM {OT} AS t",
          ["o_totalprice"])
def c6(spark, sf):
    return K.convert_types(orders_text(spark, sf), _TYPES)


_REPORT = [("o_orderkey", "bigint", "BIGINT"), ("o_totalprice", "double", "DOUBLE"),
           ("o_orderdate", "timestamp_ntz", "TIMESTAMP"), ("o_orderstatus", "int", "INTEGER")]
_C7_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS variable, '{t}' AS target_type, count({c}) AS n_nonnull, "
    f"count(*) FILTER (WHERE {c} IS NOT NULL AND TRY_CAST({c} AS {d}) IS NULL) AS n_failed, "
    f"(count(*) FILTER (WHERE {c} IS NOT NULL AND TRY_CAST({c} AS {d}) IS NULL)) / count({c}) AS fail_share "
    f"FROM {OT} AS t" for c, t, d in _REPORT)


@register("c7_conversion_report", _C7_SQL, ["fail_share"])
def c7(spark, sf):
    return K.conversion_report(orders_text(spark, sf), {c: t for c, t, _ in _REPORT})


# --------------------------------------------------------------------- C8
_C8_SPARK = {
    "revenue": "l_extendedprice * (1 - l_discount)",
    "charge": "l_extendedprice * (1 - l_discount) * (1 + l_tax)",
    "log_price": "ln(l_extendedprice)",
    "sqrt_qty": "sqrt(l_quantity)",
    "qty_sq": "pow(l_quantity, 2)",
    "unit_price": "try_divide(l_extendedprice, l_quantity)",
    "abs_dev": "abs(l_quantity - 25)",
    "root_price": "round(sqrt(l_extendedprice), 3)",
    "ship_year": "CAST(year(l_shipdate) AS BIGINT)",
    "ship_month": "CAST(month(l_shipdate) AS BIGINT)",
    "ship_dow": "CAST(extract(DAYOFWEEK_ISO FROM l_shipdate) AS BIGINT)",
    "ship_month_start": "CAST(date_trunc('MONTH', l_shipdate) AS TIMESTAMP_NTZ)",
    "days_to_2000": "CAST(datediff(DATE'2000-01-01', CAST(l_shipdate AS DATE)) AS BIGINT)",
    "size_class": "CASE WHEN l_quantity > 25 THEN 'large' ELSE 'small' END",
    "flag_status": "concat(upper(l_returnflag), '-', lower(l_linestatus))",
    "price_bin": "least(CAST(floor(l_extendedprice / 10000) AS BIGINT) + 1, 11)",
}
_C8_SQL_EXPR = {
    "revenue": "l_extendedprice * (1 - l_discount)",
    "charge": "l_extendedprice * (1 - l_discount) * (1 + l_tax)",
    "log_price": "ln(l_extendedprice)",
    "sqrt_qty": "sqrt(l_quantity)",
    "qty_sq": "pow(l_quantity, 2)",
    "unit_price": "CASE WHEN l_quantity <> 0 THEN l_extendedprice / l_quantity END",
    "abs_dev": "abs(l_quantity - 25)",
    "root_price": "round(sqrt(l_extendedprice), 3)",
    "ship_year": "CAST(year(l_shipdate) AS BIGINT)",
    "ship_month": "CAST(month(l_shipdate) AS BIGINT)",
    "ship_dow": "CAST(isodow(l_shipdate) AS BIGINT)",
    "ship_month_start": "CAST(date_trunc('month', l_shipdate) AS TIMESTAMP)",
    "days_to_2000": "CAST(date_diff('day', CAST(l_shipdate AS DATE), DATE '2000-01-01') AS BIGINT)",
    "size_class": "CASE WHEN l_quantity > 25 THEN 'large' ELSE 'small' END",
    "flag_status": "concat(upper(l_returnflag), '-', lower(l_linestatus))",
    "price_bin": "least(CAST(floor(l_extendedprice / 10000) AS BIGINT) + 1, 11)",
}
_C8_SQL = "SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in _C8_SQL_EXPR.items()) + " FROM lineitem"


@register("c8_derive", _C8_SQL, ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "revenue", "charge",
                                  "log_price", "sqrt_qty", "qty_sq", "unit_price", "abs_dev", "root_price"])
def c8(spark, sf):
    return K.derive(read_table(spark, sf, "lineitem"), _C8_SPARK)


_C8T_SPARK = {
    "name_len": "CAST(length(c_name) AS BIGINT)",
    "name_tail": "substring(c_name, 10)",
    "segment_lower": "lower(trim(c_mktsegment))",
    "nation_tag": "concat('N', CAST(c_nationkey AS STRING))",
    "in_debt": "c_acctbal < 0",
    "balance_class": "CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END",
}
_C8T_SQL = ("SELECT *, CAST(length(c_name) AS BIGINT) AS name_len, substring(c_name, 10) AS name_tail, "
            "lower(trim(c_mktsegment)) AS segment_lower, concat('N', CAST(c_nationkey AS VARCHAR)) AS nation_tag, "
            "c_acctbal < 0 AS in_debt, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' "
            "ELSE 'high' END AS balance_class FROM customer")


@register("c8_derive_text", _C8T_SQL, ["c_acctbal"])
def c8_text(spark, sf):
    return K.derive(read_table(spark, sf, "customer"), _C8T_SPARK)


# --------------------------------------------------------------------- C9
@register("c9_drop_duplicates", "SELECT doc_id, text, lang, source, n_chars FROM documents "
                                "QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def c9(spark, sf):
    return K.drop_duplicates(read_table(spark, sf, "documents"), subset=["text"], order_by=["doc_id"])


@register("c9_distinct_rows", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def c9_rows(spark, sf):
    return K.drop_duplicates(read_table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus"))


@register("c9_clean_text", "SELECT doc_id, nullif(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')), '') "
                           "AS text, lang, source, n_chars FROM documents")
def c9_text(spark, sf):
    return K.clean_text(read_table(spark, sf, "documents"), ["text"])


# -------------------------------------------------------------------- C10
_LI_ALL = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
           "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_SC = ["l_quantity", "l_extendedprice"]


def _scale_sql(f) -> str:
    return "SELECT " + ", ".join(f(c) + f" AS {c}" if c in _SC else c for c in _LI_ALL) + " FROM lineitem"


_STD = _scale_sql(lambda c: f"(CAST({c} AS DOUBLE) - (SELECT avg({c}) FROM lineitem)) / "
                            f"nullif((SELECT stddev_samp({c}) FROM lineitem), 0)")
_MINMAX = _scale_sql(lambda c: f"(CAST({c} AS DOUBLE) - (SELECT min({c}) FROM lineitem)) / "
                               f"nullif((SELECT max({c}) - min({c}) FROM lineitem), 0)")
_LOG = _scale_sql(lambda c: f"CASE WHEN {c} > -1 THEN ln(1.0 + {c}) END")
_DBL = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("c10_scale_standard", _STD, _DBL)
def c10_std(spark, sf):
    return K.scale(read_table(spark, sf, "lineitem"), _SC, "standard")


@register("c10_scale_minmax", _MINMAX, _DBL)
def c10_mm(spark, sf):
    return K.scale(read_table(spark, sf, "lineitem"), _SC, "minmax")


@register("c10_scale_log", _LOG, _DBL)
def c10_log(spark, sf):
    return K.scale(read_table(spark, sf, "lineitem"), _SC, "log")


# -------------------------------------------------------------------- C11
_MAP_SQL = """
SELECT variable, value, row_number() OVER (PARTITION BY variable ORDER BY count DESC, value) - 1 AS index, count
FROM (SELECT variable, value, count(*) AS count FROM (
        SELECT 'o_orderstatus' AS variable, o_orderstatus AS value FROM orders
        UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders) AS l
      WHERE value IS NOT NULL GROUP BY variable, value) AS c
"""


@register("c11_encode_mapping", _MAP_SQL)
def c11_map(spark, sf):
    return K.encode_mapping(read_table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


@register("c11_encode_mapping_many", """
SELECT variable, value, row_number() OVER (PARTITION BY variable ORDER BY count DESC, value) - 1 AS index, count
FROM (SELECT variable, value, count(*) AS count FROM (
        SELECT 'text' AS variable, text AS value FROM documents
        UNION ALL SELECT 'n_chars', CAST(n_chars AS VARCHAR) FROM documents) AS l
      WHERE value IS NOT NULL GROUP BY variable, value) AS c
""")
def c11_map_many(spark, sf):
    """As many categories as documents, and some of many equal counts."""
    return K.encode_mapping(read_table(spark, sf, "documents"), ["text", "n_chars"])


@register("c11_encode_index",
          f"WITH m AS ({_MAP_SQL}) SELECT o.*, a.index AS o_orderstatus_idx, b.index AS o_orderpriority_idx "
          "FROM orders AS o LEFT JOIN m AS a ON a.variable = 'o_orderstatus' AND a.value = o.o_orderstatus "
          "LEFT JOIN m AS b ON b.variable = 'o_orderpriority' AND b.value = o.o_orderpriority",
          ["o_totalprice"])
def c11_idx(spark, sf):
    return K.encode(read_table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], "index")
