"""Registered queries B1-B3 and V1-V9 (selection and chart tables)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tally.functions.stats import equal_width_bin_sql
from tally.operators import charts as C
from tally.plans.catalog import register
from tally.sources.files import read_table

# --------------------------------------------------------------------- B1-B3


@register("b1_select", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem", ["l_extendedprice"])
def b1(spark, sf):
    return read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")


_LI_ALL = ("l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, "
           "l_returnflag, l_linestatus, l_shipdate")
_LI_DBL = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("b2_filter", f"SELECT {_LI_ALL} FROM lineitem WHERE l_quantity > 45 AND l_discount >= 0.05", _LI_DBL)
def b2(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return li.where((F.col("l_quantity") > 45) & (F.col("l_discount") >= 0.05))


@register("b3_preview", f"SELECT {_LI_ALL} FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber "
                        "LIMIT 20", _LI_DBL)
def b3(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return C.preview(li, 20, [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber"])


# --------------------------------------------------------------------- V1


@register("v1_line_table", "SELECT o_orderstatus AS series, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS x, "
                           "avg(o_totalprice) AS y FROM orders GROUP BY 1, 2", ["y"])
def v1(spark, sf):
    return C.line_table(read_table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "avg",
                        series="o_orderstatus", freq="month")


def thinned_sql(source: str, position: str, x: str, ys: list[str], max_points: int, out: str) -> str:
    """The rows of ``source`` that stay when a line of more than ``max_points`` rows is thinned."""
    columns = max_points // (2 + 2 * len(ys))
    pixel = equal_width_bin_sql("p", "lo", "hi", columns)
    def first(order: str) -> str:
        return f"row_number() OVER (PARTITION BY pixel ORDER BY {order}) = 1"
    kept = [first("p"), first("p DESC")]
    for y in ys:
        kept += [f"({y} IS NOT NULL AND {first(f'{y} NULLS LAST, p')})", f"({y} IS NOT NULL AND {first(f'{y} DESC NULLS LAST, p')})"]
    return (f"WITH t AS ({source}), a AS (SELECT *, CAST({position} AS DOUBLE) AS p FROM t), "
            "b AS (SELECT *, count(*) OVER () AS n, min(p) OVER () AS lo, max(p) OVER () AS hi FROM a), "
            f"c AS (SELECT *, {pixel} AS pixel FROM b) "
            f"SELECT {out} FROM c QUALIFY n <= {max_points} OR (p IS NOT NULL AND ({' OR '.join(kept)}))")


@register("v1_line_table_bounded", thinned_sql("SELECT ts AS x, avg(value) AS y FROM events GROUP BY 1", "epoch_us(x)", "x", ["y"],
                                               400, "x, y"), ["y"])
def v1_bounded(spark, sf):
    return C.line_table(read_table(spark, sf, "events"), "ts", "value", "avg", max_points=400)


# --------------------------------------------------------------------- V2
_V2_SQL = """
WITH per AS (SELECT CAST(l_suppkey AS VARCHAR) AS category, sum(CAST(l_extendedprice AS DOUBLE)) AS value
             FROM lineitem GROUP BY 1),
top AS (SELECT category, value, row_number() OVER (ORDER BY value DESC, category) AS rank FROM per QUALIFY rank <= 20)
SELECT category, value, rank FROM top
UNION ALL
SELECT '(other)', sum(value), NULL FROM per WHERE category NOT IN (SELECT category FROM top) HAVING count(*) > 0
"""


@register("v2_bar_table", _V2_SQL, ["value"])
def v2(spark, sf):
    return C.bar_table(read_table(spark, sf, "lineitem"), "l_suppkey", "l_extendedprice", "sum", top=20)


# --------------------------------------------------------------------- V3
_BX = equal_width_bin_sql("x", "x0", "x1", 20)
_BY = equal_width_bin_sql("y", "y0", "y1", 20)
_V3_SQL = f"""
WITH p AS (SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem
           WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL),
l AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p),
b AS (SELECT {_BX} AS bin_x, {_BY} AS bin_y, x0, x1, y0, y1 FROM p, l)
SELECT bin_x, bin_y, x0 + (bin_x - 1) * ((x1 - x0) / 20) AS x_lo, x0 + bin_x * ((x1 - x0) / 20) AS x_hi,
       y0 + (bin_y - 1) * ((y1 - y0) / 20) AS y_lo, y0 + bin_y * ((y1 - y0) / 20) AS y_hi, count(*) AS count
FROM b GROUP BY bin_x, bin_y, x0, x1, y0, y1
"""


@register("v3_scatter_bins", _V3_SQL, ["x_lo", "x_hi", "y_lo", "y_hi"])
def v3(spark, sf):
    return C.scatter_table(read_table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", mode="bins", bins=20)


@register("v3_scatter_raw", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS x, "
                            "CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem", ["x", "y"])
def v3_raw(spark, sf):
    return C.scatter_table(read_table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", mode="raw",
                           key=["l_orderkey", "l_linenumber"])


# --------------------------------------------------------------------- V4
_HB = equal_width_bin_sql("v", "_lo", "_hi", 10)
_V4_SQL = f"""
WITH v AS (SELECT CAST(value AS DOUBLE) AS v FROM events WHERE value IS NOT NULL AND NOT isnan(value)),
l AS (SELECT min(v) AS _lo, max(v) AS _hi FROM v),
c AS (SELECT {_HB} AS bin, count(*) AS n FROM v, l GROUP BY 1),
g AS (SELECT range AS bin, _lo, _hi FROM l, range(1, 11))
SELECT g.bin, _lo + (g.bin - 1) * ((_hi - _lo) / 10) AS lo, _lo + g.bin * ((_hi - _lo) / 10) AS hi,
       coalesce(c.n, 0) AS count
FROM g LEFT JOIN c ON g.bin = c.bin
"""


@register("v4_histogram_table", _V4_SQL, ["lo", "hi"])
def v4(spark, sf):
    return C.histogram_table(read_table(spark, sf, "events"), "value", bins=10)


# --------------------------------------------------------------------- V5
_V5_SQL = """
WITH b AS (SELECT event_type AS category, CAST(value AS DOUBLE) AS v FROM events WHERE value IS NOT NULL),
q AS (SELECT category, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3
      FROM b GROUP BY category)
SELECT category, q1, median, q3, count(*) AS n,
       min(CASE WHEN v >= q1 - 1.5 * (q3 - q1) THEN v END) AS whisker_lo,
       max(CASE WHEN v <= q3 + 1.5 * (q3 - q1) THEN v END) AS whisker_hi,
       count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM b JOIN q USING (category) GROUP BY category, q1, median, q3
"""


@register("v5_box_table", _V5_SQL, ["q1", "median", "q3", "whisker_lo", "whisker_hi"])
def v5_box(spark, sf):
    return C.box_table(read_table(spark, sf, "events"), "event_type", "value")


_DENSITY = """
WITH s AS (SELECT event_type AS category, count(*) AS n, min(value) AS lo, max(value) AS hi, 1.06 * stddev_samp(value) * pow(count(*), -0.2) AS h
           FROM events GROUP BY 1),
z AS (SELECT category, n, h, lo - 3 * h AS start, (hi - lo + 6 * h) / 63 AS step FROM s),
a AS (SELECT z.*, least(CAST(floor((e.value - start) / step) AS INTEGER), 62) AS low, (e.value - start) / step AS pos
      FROM events AS e JOIN z ON e.event_type = z.category),
b AS (SELECT category, low AS bin, sum(1 - (pos - low)) AS w FROM a GROUP BY 1, 2 UNION ALL
      SELECT category, low + 1, sum(pos - low) FROM a GROUP BY 1, 2)
SELECT category, start + g * step AS x, sum(w * exp(-0.5 * pow((g - bin) * step / h, 2)) / (h * sqrt(2 * pi()) * n)) AS density
FROM b JOIN z USING (category), range(0, 64) AS r(g) GROUP BY category, g, start, step
"""


@register("v5_density_table", _DENSITY, ["x", "density"], digits=6)
def v5_density(spark, sf):
    return C.density_table(read_table(spark, sf, "events"), "value", "event_type", points=64)


@register("v5_share_table", "SELECT o_orderpriority AS category, sum(o_totalprice) AS value, "
                            "sum(o_totalprice) / sum(sum(o_totalprice)) OVER () AS share FROM orders GROUP BY 1",
          ["value", "share"])
def v5_share(spark, sf):
    return C.share_table(read_table(spark, sf, "orders"), "o_orderpriority", "o_totalprice", "sum")


# ------------------------------------------------------------------ V6 V7
def _monthly_pair(spark, sf):
    o = C.line_table(read_table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "sum", freq="month")
    li = C.line_table(read_table(spark, sf, "lineitem"), "l_shipdate", "l_extendedprice", "sum", freq="month")
    return o, li


_MO = ("SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS x, sum(o_totalprice) AS y "
       "FROM orders GROUP BY 1")
_ML = ("SELECT CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS x, sum(l_extendedprice) AS y "
       "FROM lineitem GROUP BY 1")


@register("v6_compare_tables", f"SELECT 'orders' AS panel, * FROM ({_MO}) UNION ALL "
                               f"SELECT 'lineitem' AS panel, * FROM ({_ML})", ["y"])
def v6(spark, sf):
    o, li = _monthly_pair(spark, sf)
    return C.compare_tables({"orders": o, "lineitem": li})


_V6D_SQL = (f"SELECT coalesce(a.x, b.x) AS x, a.y AS y_orders, b.y AS y_lineitem, b.y - a.y AS delta, "
            f"CASE WHEN a.y <> 0 THEN b.y / a.y END AS ratio FROM ({_MO}) a FULL OUTER JOIN ({_ML}) b "
            f"ON a.x IS NOT DISTINCT FROM b.x")


@register("v6_compare_diff", _V6D_SQL, ["y_orders", "y_lineitem", "delta", "ratio"])
def v6_diff(spark, sf):
    o, li = _monthly_pair(spark, sf)
    return C.compare_diff(o, li, on="x", names=("orders", "lineitem"))


@register("v7_overlay_tables", f"SELECT coalesce(a.x, b.x) AS x, a.y AS y_orders, b.y AS y_lineitem "
                               f"FROM ({_MO}) a FULL OUTER JOIN ({_ML}) b ON a.x IS NOT DISTINCT FROM b.x",
          ["y_orders", "y_lineitem"])
def v7(spark, sf):
    o, li = _monthly_pair(spark, sf)
    return C.overlay_tables(o, li, on="x", names=("orders", "lineitem"))


_DAYS = ("SELECT coalesce(a.x, b.x) AS x, a.y AS y_orders, b.y AS y_lineitem FROM "
         "(SELECT CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS x, sum(o_totalprice) AS y FROM orders GROUP BY 1) a FULL OUTER JOIN "
         "(SELECT CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS x, sum(l_extendedprice) AS y FROM lineitem GROUP BY 1) b ON a.x = b.x")


@register("v7_overlay_tables_bounded", thinned_sql(_DAYS, "epoch_us(x)", "x", ["y_orders", "y_lineitem"], 300, "x, y_orders, y_lineitem"),
          ["y_orders", "y_lineitem"])
def v7_bounded(spark, sf):
    o = C.line_table(read_table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "sum", freq="day", max_points=None)
    li = C.line_table(read_table(spark, sf, "lineitem"), "l_shipdate", "l_extendedprice", "sum", freq="day", max_points=None)
    return C.overlay_tables(o, li, on="x", names=("orders", "lineitem"), max_points=300)


# --------------------------------------------------------------------- V8
@register("v8_overlay_by_slot", "SELECT CAST(date_trunc('week', ts) AS TIMESTAMP) AS series, "
                                "CAST(hour(ts) AS BIGINT) AS slot, avg(value) AS y FROM events GROUP BY 1, 2", ["y"])
def v8(spark, sf):
    return C.overlay_by_slot(read_table(spark, sf, "events"), "ts", "value", slot="hour", series="week")


@register("v8_overlay_by_weekday", "SELECT CAST(date_trunc('year', o_orderdate) AS TIMESTAMP) AS series, "
                                   "CAST(isodow(o_orderdate) AS BIGINT) AS slot, avg(o_totalprice) AS y "
                                   "FROM orders GROUP BY 1, 2", ["y"])
def v8_dow(spark, sf):
    return C.overlay_by_slot(read_table(spark, sf, "orders"), "o_orderdate", "o_totalprice", slot="dow",
                             series="year")


# --------------------------------------------------------------------- V9
EVENT_TYPES = ["view", "signup", "click", "purchase", "error"]
_V9_SQL = ("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS x, "
           + ", ".join(f"avg(value) FILTER (WHERE event_type = '{t}') AS \"{t}\"" for t in EVENT_TYPES)
           + ", avg(value) FILTER (WHERE event_type IS NULL OR event_type NOT IN ("
           + ", ".join(f"'{t}'" for t in EVENT_TYPES) + ")) AS \"(other)\" FROM events GROUP BY 1")


@register("v9_overlay_by_category", _V9_SQL, [*EVENT_TYPES, "(other)"])
def v9(spark, sf):
    return C.overlay_by_category(read_table(spark, sf, "events"), "ts", "event_type", "value",
                                 values=EVENT_TYPES, agg="avg", freq="day")
