"""Tables derived from the given ones by rule (FIXTURES.md section 3).

Each derivation is a Spark plan over a whole given table, with an SQL twin
so the oracle can rebuild the same rows.  No row is dropped to make a check
cheaper: the rules only inject NULLs, text, duplicates or gaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.sources.files import read_table


def events_nulls(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events")
    return e.select(
        "event_id", "ts", "user_id",
        F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("event_type"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
        "props")


EVENTS_NULLS_SQL = ("(SELECT event_id, ts, user_id, "
                    "CASE WHEN event_id % 11 <> 0 THEN event_type END AS event_type, "
                    "CASE WHEN event_id % 7 <> 0 THEN value END AS value, props FROM events)")


def events_missing(spark: SparkSession, sf: str) -> DataFrame:
    """As ``events_nulls``, and some values are NaN: missing like NULL, so the
    twin has NULL for both."""
    e = read_table(spark, sf, "events")
    return e.select(
        "event_id", "ts", "user_id",
        F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("event_type"),
        F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 13 != 0, F.col("value")).alias("value"),
        "props")


EVENTS_MISSING_SQL = ("(SELECT event_id, ts, user_id, CASE WHEN event_id % 11 <> 0 THEN event_type END AS event_type, "
                      "CASE WHEN event_id % 7 <> 0 AND event_id % 13 <> 0 THEN value END AS value, props FROM events)")


def blobs(spark: SparkSession, sf: str) -> DataFrame:
    """Four separate groups of points by the orders' keys; ``g`` is the group."""
    k = F.col("o_orderkey")
    return read_table(spark, sf, "orders").select(
        k.alias("id"), (k % 4).alias("g"), (10.0 * (k % 2) + (k % 17) / 17.0).alias("x"),
        (10.0 * F.floor((k % 4) / 2) + (k % 19) / 19.0).alias("y"))


BLOBS_SQL = ("(SELECT o_orderkey AS id, o_orderkey % 4 AS g, 10.0::DOUBLE * (o_orderkey % 2) + (o_orderkey % 17) / 17.0::DOUBLE AS x, "
             "10.0::DOUBLE * ((o_orderkey % 4) // 2) + (o_orderkey % 19) / 19.0::DOUBLE AS y FROM orders)")


def orders_text(spark: SparkSession, sf: str) -> DataFrame:
    """All columns as text, as a CSV upload would give; some prices are 'n/a'."""
    o = read_table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.col("o_custkey").cast("string").alias("o_custkey"),
        "o_orderstatus",
        F.when(F.col("o_orderkey") % 50 == 0, F.lit("n/a"))
         .otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
        "o_orderpriority")


ORDERS_TEXT_SQL = ("(SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, "
                   "o_orderstatus, CASE WHEN o_orderkey % 50 = 0 THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR) END "
                   "AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders)")


def customer_rfm(spark: SparkSession, sf: str) -> DataFrame:
    """Per customer: frequency (orders), monetary (total price) and recency
    (days from the customer's last order to the last order date overall).
    One aggregate on orders (partial aggregation), one broadcast scalar."""
    o = read_table(spark, sf, "orders")
    per = o.groupBy("o_custkey").agg(
        F.count(F.lit(1)).cast("double").alias("frequency"),
        F.sum("o_totalprice").alias("monetary"),
        F.max("o_orderdate").alias("_last"))
    end = o.agg(F.max("o_orderdate").alias("_end"))
    return (per.crossJoin(F.broadcast(end))
            .select(F.col("o_custkey").alias("custkey"), "frequency", "monetary",
                    F.datediff(F.col("_end"), F.col("_last")).cast("double").alias("recency")))


CUSTOMER_RFM_SQL = ("(SELECT o_custkey AS custkey, CAST(count(*) AS DOUBLE) AS frequency, "
                    "sum(o_totalprice) AS monetary, "
                    "CAST(date_diff('day', max(o_orderdate), (SELECT max(o_orderdate) FROM orders)) AS DOUBLE) "
                    "AS recency FROM orders GROUP BY o_custkey)")


def doc_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their quality / toxicity labels and simple numeric
    features computed from the whole text by built-in functions."""
    d = read_table(spark, sf, "documents")
    lab = read_table(spark, sf, "labels")
    return d.join(lab, "doc_id").select(
        "doc_id", "lang", "source", "quality", "toxic",
        F.col("n_chars").cast("double").alias("n_chars"),
        F.size(F.split(F.col("text"), "\n")).cast("double").alias("n_lines"),
        F.size(F.split(F.trim(F.col("text")), "[ \t\n\r\f]+")).cast("double").alias("n_words"),
        (F.length(F.regexp_replace("text", "[^0-9]", "")) / F.greatest(F.col("n_chars"), F.lit(1)))
        .alias("digit_share"))
