"""Mergeable profiles, density curves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tally.operators import charts as C
from tally.operators import sketches as S
from tally.session import written


def rows(spark, n=20_000):
    x = F.pmod(F.col("id") * 7919, F.lit(10_007)).cast("double")
    return spark.range(n).select(
        F.pmod("id", F.lit(7)).alias("part"), F.when(F.col("id") % 11 != 0, x).alias("x"),
        (1e9 + F.sin("id")).alias("n"), F.when(F.col("id") % 5 == 0, F.lit(float("nan"))).otherwise(F.lit(2.0)).alias("c"),
        F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 4 == 0, "b").when(F.col("id") % 10 > 0, F.col("id").cast("string")).alias("s"))


def test_merged_states_equal_the_whole(spark):
    df = rows(spark)
    p = df.select("x", "n", "c").toPandas()
    states = written(S.numeric_state(df, ["x", "n", "c"], ["part"]), "test-states")
    got = {r["variable"]: r for r in S.numeric_profile(states).collect()}
    for c in ("x", "n", "c"):
        v = p[c].dropna()
        assert (got[c]["count"], got[c]["n_null"]) == (len(v), len(p) - len(v))
        assert (got[c]["min"], got[c]["max"]) == (v.min(), v.max()) and got[c]["mean"] == pytest.approx(v.mean(), rel=1e-12)
        assert got[c]["std"] == pytest.approx(v.std(), rel=1e-6, abs=1e-12)
        assert got[c]["n_distinct"] == pytest.approx(v.nunique(), rel=0.08)
        for q in (25, 50, 75):
            e = got[c][f"p{q}"]
            assert (v < e).mean() <= q / 100 + 0.03 and (v <= e).mean() >= q / 100 - 0.03


def test_a_new_part_reads_no_old_rows(spark):
    df = rows(spark)
    old = written(S.numeric_state(df.where("part < 6"), ["x"], ["part"]), "test-states")
    both = old.unionByName(S.numeric_state(df.where("part = 6"), ["x"], ["part"]))
    kept = written(S.merge_numeric(both), "test-states")  # states merge to a state again
    assert "Range" not in S.merge_numeric(old)._jdf.queryExecution().optimizedPlan().toString()
    a, b = S.numeric_profile(kept).first(), S.numeric_profile(S.numeric_state(df, ["x"], ["part"])).first()
    assert (a["count"], a["n_null"], a["min"], a["max"]) == (b["count"], b["n_null"], b["min"], b["max"])
    assert a["mean"] == pytest.approx(b["mean"]) and a["std"] == pytest.approx(b["std"])
    by = S.numeric_profile(written(S.numeric_state(df, ["x"], ["part", "s"]), "test-states"), by=["part"])
    assert by.count() == 7 and by.agg(F.sum("count")).first()[0] == b["count"]


def test_heavy_hitters(spark):
    df = rows(spark)
    states = written(S.categorical_state(df, ["s", "c"], ["part"]), "test-states")
    got = {r["variable"]: r for r in S.categorical_profile(states, 2).collect()}
    want = df.groupBy("s").count().where("s in ('a', 'b')").collect()
    assert [(t["value"], t["count"]) for t in got["s"]["top"]] == sorted([(r["s"], r["count"]) for r in want], key=lambda t: -t[1])
    assert got["s"]["n_null"] == df.where("s is null").count()
    assert got["s"]["n_distinct"] == pytest.approx(df.select("s").distinct().count() - 1, rel=0.08)


def test_empty_and_missing_parts(spark):
    df = rows(spark).withColumn("x", F.when(F.col("part") != 3, F.col("x")))
    r = S.numeric_profile(written(S.numeric_state(df, ["x"], ["part"]), "test-states")).first()
    assert r["count"] == df.where("x is not null").count() and r["p50"] is not None
    nothing = S.numeric_profile(written(S.numeric_state(df.where("part = 3"), ["x"], ["part"]), "test-states")).first()
    assert (nothing["count"], nothing["p50"], nothing["n_distinct"], nothing["std"]) == (0, None, 0, None)
    assert S.numeric_profile(S.numeric_state(df.limit(0), ["x"], ["part"])).collect() == []
    assert S.categorical_profile(S.categorical_state(df.limit(0), ["s"], ["part"])).collect() == []


def test_density_integrates_to_one_and_matches_the_kernel(spark):
    rng = np.random.default_rng(6)
    data = [("u", float(v)) for v in rng.normal(5, 2, 500)] + [(None, float(v)) for v in rng.exponential(1, 300)] + [
        ("same", 4.0)] * 30 + [("u", None), ("u", float("nan"))]
    out = C.density_table(spark.createDataFrame(data, "k string, v double"), "v", "k", points=200).toPandas()
    assert len(out) == 600
    for k in ("u", None, "same"):
        mine = (out[out["category"].isna()] if k is None else out[out["category"] == k]).sort_values("x")
        v = np.array([x for c, x in data if c == k and x is not None and x == x])
        h = 1.06 * v.std(ddof=1) * len(v) ** -0.2 if v.std() else 1.0
        exact = np.exp(-0.5 * ((mine["x"].to_numpy()[:, None] - v) / h) ** 2).sum(1) / (len(v) * h * np.sqrt(2 * np.pi))
        assert np.trapezoid(mine["density"], mine["x"]) == pytest.approx(1.0, abs=0.01)
        assert np.allclose(mine["density"], exact, atol=0.01 * exact.max())
    assert C.density_table(spark.createDataFrame([], "v double"), "v").collect() == []
