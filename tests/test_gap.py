"""The gap statistic: dispersions against numpy, the chosen k on planted tables, odd tables."""

import math

import numpy as np
import pytest

from tally.operators import cluster as K


def _frame(spark, points):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "id long, x double, y double")


def _gap(df, ks, **kw):
    return {r["k"]: r for r in K.gap_statistic(df, ["x", "y"], ks, **kw).collect()}


def test_three_groups_are_found_and_one_cloud_is_one(spark):
    rng = np.random.default_rng(5)
    groups = np.concatenate([rng.normal(c, 0.3, (150, 2)) for c in ((0, 0), (6, 0), (3, 7))])
    got = _gap(_frame(spark, groups), [1, 2, 3, 4, 5], references=5)
    assert [k for k, r in got.items() if r["chosen"]] == [3]
    cloud = rng.uniform(0, 1, (300, 2))
    got = _gap(_frame(spark, cloud), [1, 2, 3, 4], references=8)
    assert [k for k, r in got.items() if r["chosen"]] == [1]


def test_dispersion_of_one_cluster_and_criterion(spark):
    rng = np.random.default_rng(6)
    p = rng.normal(0, 1, (200, 2)) @ np.array([[3, 2], [0, 1]])
    got = _gap(_frame(spark, p), [1, 2, 3], references=4, scale=False, rotate=False)
    assert got[1]["log_w"] == pytest.approx(math.log(((p - p.mean(0)) ** 2).sum()))
    turned = _gap(_frame(spark, p), [1], references=4, scale=False)
    assert turned[1]["log_w"] == pytest.approx(got[1]["log_w"])  # a rotation keeps distances
    # the box along the axes of the data is smaller than the upright one
    assert turned[1]["reference_log_w"] < got[1]["reference_log_w"]
    for r in got.values():
        assert r["gap"] == pytest.approx(r["reference_log_w"] - r["log_w"]) and r["s"] > 0
    assert sum(r["chosen"] for r in got.values()) == 1


def test_reference_rows_fill_the_box_and_repeat(spark):
    a = K.reference_rows(spark, 4000, [0.0, -5.0], [1.0, 5.0], 7)
    rows = np.array([r["features"].toArray() for r in a.collect()])
    assert rows.min(0) == pytest.approx([0, -5], abs=0.02) and rows.max(0) == pytest.approx([1, 5], abs=0.02)
    assert rows.mean(0) == pytest.approx([0.5, 0], abs=0.2) and abs(np.corrcoef(rows.T)[0, 1]) < 0.06
    again = K.reference_rows(spark, 4000, [0.0, -5.0], [1.0, 5.0], 7).repartition(3)
    assert sorted(map(tuple, rows)) == sorted(tuple(r["features"]) for r in again.collect())
    other = K.reference_rows(spark, 4000, [0.0, -5.0], [1.0, 5.0], 8)
    assert not set(map(tuple, rows)) & {tuple(r["features"]) for r in other.collect()}


def test_odd_tables(spark):
    empty = _frame(spark, [(0, 0)]).where("false")
    assert all(r["gap"] is None and not r["chosen"] for r in _gap(empty, [1, 2]).values())
    holes = spark.createDataFrame([(1, None, 1.0), (2, float("nan"), 2.0)], "id long, x double, y double")
    assert all(r["gap"] is None for r in _gap(holes, [1, 2]).values())
    same = _gap(_frame(spark, [(1, 1)] * 20), [1, 2], references=2, scale=False)
    assert all(r["log_w"] is None and not r["chosen"] for r in same.values())
    with pytest.raises(ValueError):
        K.gap_statistic(empty, ["x"], [0, 1])


def test_only_plain_numbers_are_cached(spark, monkeypatch):
    df, cached = _frame(spark, [(i % 7, i % 5) for i in range(70)]), []
    persist = type(df).persist
    monkeypatch.setattr(type(df), "persist", lambda self, *a: cached.append(self.schema) or persist(self, *a))
    _gap(df, [1, 2], references=2)
    assert [[f.dataType.typeName() for f in s] for s in cached] == [["double", "double"]]


def test_rows_far_from_the_origin(spark):
    same = _gap(_frame(spark, [(1e6 + 0.1, 0.3)] * 9 + [(1e6 + 0.7, 0.9)] * 9), [2, 3], references=2, scale=False)
    assert all(r["log_w"] is None and not r["chosen"] for r in same.values())
    near = _gap(_frame(spark, [(x + d, x) for x in (0, 5) for d in (0.0, 0.1)]), [2], references=2, scale=False, rotate=False)
    far = _gap(_frame(spark, [(x + d + 2**30, x) for x in (0, 5) for d in (0.0, 0.1)]), [2], references=2, scale=False, rotate=False)
    assert far[2]["log_w"] == pytest.approx(near[2]["log_w"], rel=1e-5)
