"""Registered queries S1, S4 and X1 (file sources and sinks).

Round trips write a whole given table (or a chart table computed from one)
under the session's shared checkpoint folder and read it back with the
original schema; the oracle is the table itself.
"""

from __future__ import annotations

from tally.operators import charts as C
from tally.plans.catalog import register
from tally.plans.q_charts import _V4_SQL
from tally.plans.q_timeseries import _M, monthly_revenue
from tally.session import scratch_path
from tally.sources.files import export_table, read_back, read_csv, read_table
from tally.sources.xlsx import read_xlsx, write_xlsx

_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"


@register("s1_read_csv", _ORDERS, ["o_totalprice"])
def s1(spark, sf):
    o = read_table(spark, sf, "orders")
    path = export_table(o, scratch_path(spark, "orders-csv"), "csv")
    return read_csv(spark, path, schema=o.schema)


@register("s1_read_csv_inferred")
def s1_infer(spark, sf):
    o = read_table(spark, sf, "orders")
    path = export_table(o, scratch_path(spark, "orders-csv"), "csv")
    return read_csv(spark, path, schema=None)


@register("s4_read_table", "SELECT * FROM lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
def s4(spark, sf):
    return read_table(spark, sf, "lineitem")


@register("x1_export_parquet", _V4_SQL, ["lo", "hi"])
def x1_parquet(spark, sf):
    h = C.histogram_table(read_table(spark, sf, "events"), "value", bins=10)
    path = export_table(h, scratch_path(spark, "hist-parquet"), "parquet", single_file=True)
    return read_back(spark, path, "parquet", h.schema)


@register("x1_export_csv", _M, ["y"])
def x1_csv(spark, sf):
    m = monthly_revenue(spark, sf)
    path = export_table(m, scratch_path(spark, "monthly-csv"), "csv", single_file=True)
    return read_back(spark, path, "csv", m.schema)


@register("x1_export_json", _M, ["y"])
def x1_json(spark, sf):
    m = monthly_revenue(spark, sf)
    path = export_table(m, scratch_path(spark, "monthly-json"), "json")
    return read_back(spark, path, "json", m.schema)


@register("s2_read_xlsx", _ORDERS, ["o_totalprice"])
def s2(spark, sf):
    """orders written as one workbook per partition, read back in parallel."""
    o = read_table(spark, sf, "orders")
    folder = write_xlsx(o, scratch_path(spark, "orders-xlsx"))
    return read_xlsx(spark, folder, o.schema)


@register("s2_read_xlsx_bytes", _ORDERS, ["o_totalprice"])
def s2_bytes(spark, sf):
    """The same through Spark's own file systems, from workbooks of at most 4000 rows."""
    o = read_table(spark, sf, "orders")
    folder = write_xlsx(o, scratch_path(spark, "orders-xlsx"), sheet_rows=4000)
    return read_xlsx(spark, folder, o.schema, as_bytes=True)


_DOCS = "SELECT doc_id, text, lang, source, n_chars FROM documents"


@register("s1_read_csv_documents", _DOCS)
def s1_documents(spark, sf):
    """Whole texts with line breaks, quotes and separators through a
    semicolon-separated file."""
    d = read_table(spark, sf, "documents")
    path = export_table(d, scratch_path(spark, "documents-csv"), "csv", sep=";", null_value="NA")
    return read_csv(spark, path, schema=d.schema, sep=";", null_value="NA")


@register("x1_export_csv_documents", _DOCS)
def x1_documents(spark, sf):
    d = read_table(spark, sf, "documents")
    return read_back(spark, export_table(d, scratch_path(spark, "documents-csv"), "csv"), "csv", d.schema)
