"""The flagship query: monthly order revenue -> seasonal decomposition
(period 12) joined with a 3-month moving average."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tally.functions.stats import finalize
from tally.plans.q_timeseries import decompose_with_ma


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return finalize(decompose_with_ma(spark, sf))
