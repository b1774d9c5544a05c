"""Lines bounded for drawing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tally.operators import charts as C
from tally.operators import profile as P


def wave(spark, n, series="a"):
    return spark.range(n).select(F.lit(series).alias("s"), F.col("id").cast("double").alias("x"),
                                 (F.sin(F.col("id") / 40.0) * 10 + F.pmod(F.col("id") * 7919, F.lit(97)) / 50.0).alias("y"))


def test_a_long_line_keeps_its_outline(spark):
    df = wave(spark, 5000).unionByName(wave(spark, 30, "short")).unionByName(wave(spark, 4000, None))
    spike = df.withColumn("y", F.when((F.col("x") == 1234) & (F.col("s") == "a"), 500.0).otherwise(F.col("y")))
    out = C.line_table(spike, "x", "y", series="s", max_points=200).toPandas()
    full = spike.toPandas()
    for s, n in (("a", 5000), ("short", 30), (None, 4000)):
        mine = out[out["series"].isna()] if s is None else out[out["series"] == s]
        own = full[full["s"].isna()] if s is None else full[full["s"] == s]
        assert len(mine) <= 200 and (n > 200 or len(mine) == n)
        for side in ("min", "max"):
            assert getattr(mine["y"], side)() == getattr(own["y"], side)() and getattr(mine["x"], side)() == getattr(own["x"], side)()
        if n > 200:  # the extremes of every pixel column stay
            pixel = np.minimum((own["x"] / own["x"].max() * 50).astype(int), 49)
            kept = np.minimum((mine["x"] / own["x"].max() * 50).astype(int), 49)
            for side in ("min", "max"):
                assert (getattr(own.groupby(pixel.values)["y"], side)() == getattr(mine.groupby(kept.values)["y"], side)()).all()


def test_bounds_missing_values_and_axes(spark):
    df = wave(spark, 3000).withColumn("y", F.when(F.pmod("x", F.lit(3)) == 0, F.lit(float("nan"))).otherwise(F.col("y")))
    assert C.line_table(df, "x", "y", max_points=100).count() <= 100
    assert C.line_table(df, "x", "y").count() <= C.MAX_POINTS
    assert C.line_table(df, "x", "y", max_points=None).count() == 3000
    text = df.select(F.col("x").cast("string").alias("x"), "y")
    assert C.line_table(text, "x", "y", max_points=100).count() == 3000  # no axis to thin along
    for kind in ("date", "timestamp", "timestamp_ntz"):
        days = df.select(F.date_add(F.lit("2000-01-01").cast("date"), F.col("x").cast("int")).cast(kind).alias("x"), "y")
        assert 50 <= C.line_table(days, "x", "y", max_points=100).count() <= 100
    with pytest.raises(ValueError):
        C.thin_lines(df.select("x", "y"), 3)
    assert C.thin_lines(df.select("x", "y").limit(0), 10).collect() == []


def test_two_lines_and_the_distribution_curve(spark):
    a, b = wave(spark, 2500).select("x", "y"), wave(spark, 2600).selectExpr("x + 0.5 as x", "y * 3 as y")
    out = C.overlay_tables(a, b, max_points=120).toPandas()
    assert len(out) <= 120 and out["y_b"].max() == b.agg(F.max("y")).first()[0] and out["y_a"].min() == a.agg(F.min("y")).first()[0]
    curve = P.ecdf(wave(spark, 5000), "y", max_points=100).orderBy("value").toPandas()
    assert len(curve) <= 100 and curve["ecdf"].is_monotonic_increasing and curve["ecdf"].iloc[-1] == 1.0
