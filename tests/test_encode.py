"""Category indices by ranges, and confusion matrices of many classes."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tally.operators import clean as C
from tally.operators import evaluate as M


def _want(values):
    n = pd.Series([v for v in values if v is not None], dtype="object").value_counts()
    order = sorted(n.index, key=lambda v: (-n[v], v.encode()))
    return {v: (i, int(n[v])) for i, v in enumerate(order)}


@pytest.mark.parametrize("buckets", [1, 3, 16])
def test_index_is_the_rank_whatever_the_ranges(spark, buckets):
    values = [f"key {i % 700:04d}" for i in range(900)] + ["hot"] * 500 + ["", "é", "ü", None, "x" * 300 + "a", "x" * 300 + "b"]
    other = [None if i % 2 else str(i % 9) for i in range(len(values))]
    df = spark.createDataFrame(list(zip(values, other)), "a string, b string").repartition(5)
    got = {}
    for r in C.encode_mapping(df, ["a", "b"], buckets=buckets).collect():
        got.setdefault(r["variable"], {})[r["value"]] = (r["index"], r["count"])
    assert got == {"a": _want(values), "b": _want(other)}


def test_ranges_beyond_the_sample(spark, monkeypatch):
    monkeypatch.setattr(C, "SAMPLED", 8)
    df = spark.range(3000).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("a"))
    mapping = C.encode_mapping(df, ["a"], buckets=6)
    assert [r["value"] for r in mapping.orderBy("index").collect()] == sorted(f"v{i}" for i in range(3000))
    # no window over the whole column: the largest (count, range) is a part of it
    assert C.encode_mapping(df.where("false"), ["a"]).count() == 0
    assert C.encode_mapping(df.select(F.lit(None).cast("string").alias("a")), ["a"]).count() == 0


def test_cells_that_occur(spark):
    df = spark.range(4000).select((F.col("id") % 2000).alias("label"), ((F.col("id") * 7) % 2000).alias("prediction"))
    sparse = M.confusion_matrix(df, zero_cells=False)
    assert sparse.count() == 2000 and sparse.agg(F.sum("count")).first()[0] == 4000
    few = df.where("id < 40")
    both = {(r["label"], r["prediction"]): r["count"] for r in M.confusion_matrix(few).collect() if r["count"]}
    assert both == {(r["label"], r["prediction"]): r["count"] for r in M.confusion_matrix(few, zero_cells=False).collect()}
