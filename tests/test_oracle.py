"""Every registered query with an SQL twin agrees with DuckDB on sf0.001
(the driver checks the same at sf0.01)."""

import pytest

import __spark_entry__ as E
from conftest import SF_TINY
from oracle_util import compare, duck

SQL = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF_TINY)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    compare(QUERIES[name](spark, SF_TINY), con, SQL[name])


@pytest.mark.parametrize("name", ["d5_ecdf", "d8_spearman", "m6_roc_curve", "c3_impute_mode", "v2_bar_table"])
def test_partition_independent(spark, con, name):
    """Same result with 1 and 7 shuffle partitions (running sums, top-k and
    modes must not depend on the layout)."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            compare(QUERIES[name](spark, SF_TINY), con, SQL[name])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.mark.parametrize("name", ["d1_describe_numeric", "d5_distribution", "d11_insights", "v5_box_table",
                                  "c4_flag_outliers_iqr", "c4_flag_outliers_iqr_by", "c5_drop_outliers",
                                  "d5_ecdf", "d8_spearman", "m6_roc_curve", "m6_auc"])
@pytest.mark.parametrize("parts", ["1", "23"])
def test_ranking_matches_sql_with_any_number_of_ranges(spark, con, name, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        compare(QUERIES[name](spark, SF_TINY), con, SQL[name])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
