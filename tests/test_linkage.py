"""Exact single linkage against the textbook algorithm."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tally.operators import linkage as L


def brute_heights(x):
    """Prim's minimum spanning tree over all pairs."""
    n = len(x)
    near, done, out = np.full(n, np.inf), np.zeros(n, bool), []
    i = 0
    for _ in range(n - 1):
        done[i] = True
        near = np.minimum(near, np.sqrt(((x - x[i]) ** 2).sum(axis=1)))
        i = int(np.where(done, np.inf, near).argmin())
        out.append(near[i])
    return sorted(out)


def frame(spark, x):
    return spark.createDataFrame([(i * 7 % 100_003, *map(float, v)) for i, v in enumerate(x)],
                                 "id long, " + ", ".join(f"f{j} double" for j in range(x.shape[1])))


def points(kind):
    rng = np.random.default_rng(11)
    return {"clusters": np.concatenate([rng.normal(c, s, (250, 2)) for c, s in (((0, 0), 1), ((9, 0), 0.05), ((4, 30), 3))]),
            "chain": np.stack([np.cumsum(rng.random(250)), np.zeros(250)], axis=1),
            "three": rng.normal(0, 1, (2000, 3)) * [1, 50, 0.01],
            "copies": np.concatenate([np.repeat([[1.0, 2.0]], 400, axis=0), rng.integers(0, 12, (300, 2)).astype(float)]),
            "far": np.concatenate([rng.normal(0, 1, (80, 2)), [[1e3, 1e3], [-1e3, 3.0]]])}[kind]


@pytest.mark.parametrize("kind", ["clusters", "chain", "three", "copies", "far"])
def test_heights_equal_brute_force(spark, kind):
    x = points(kind)
    df = frame(spark, x)
    rows = L.single_linkage(df, [f"f{j}" for j in range(x.shape[1])], "id", scale=False).collect()
    assert len(rows) == len(x) - 1
    assert np.allclose(sorted(r["height"] for r in rows), brute_heights(x), rtol=1e-9, atol=1e-12)
    at = {i * 7 % 100_003: v for i, v in enumerate(x)}
    for r in rows:  # every merge names two rows at that distance, and they span all rows
        assert r["a"] < r["b"] and np.linalg.norm(at[r["a"]] - at[r["b"]]) == pytest.approx(r["height"], rel=1e-9, abs=1e-12)
    group = {i: i for i in at}

    def root(i):
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i
    for r in rows:
        a, b = root(r["a"]), root(r["b"])
        assert a != b
        group[a] = b


def test_cut_by_number_and_by_height(spark):
    x = points("clusters")[::5]
    df = frame(spark, x)
    merges = spark.createDataFrame(L.single_linkage(df, ["f0", "f1"], "id", scale=False).collect())
    h = sorted((r["height"] for r in merges.collect()), reverse=True)
    by_k = {r["id"]: r["cluster"] for r in L.cut(merges, df.select("id"), k=3).collect()}
    by_h = {r["id"]: r["cluster"] for r in L.cut(merges, df.select("id"), height=(h[1] + h[2]) / 2).collect()}
    assert by_k == by_h and len(by_k) == len(x) and len(set(by_k.values())) == 3
    for c in set(by_k.values()):
        assert c == min(i for i, g in by_k.items() if g == c)
    with pytest.raises(ValueError):
        L.cut(merges, df.select("id"))


def test_few_rows_missing_features_and_clashing_names(spark):
    df = spark.createDataFrame([(1, 0.0, "x"), (2, None, "x"), (3, float("nan"), "y"), (4, 2.0, "y"), (None, 5.0, "z")],
                               "id long, x double, comp string")
    rows = L.single_linkage(df, ["x"], "id", scale=False).collect()
    assert [(r["a"], r["b"], r["height"]) for r in rows] == [(1, 4, 2.0)]
    assert L.single_linkage(df.limit(0), ["x"], "id", scale=False).collect() == []
    assert L.single_linkage(df.where("id = 1"), ["x"], "id", scale=False).collect() == []


@pytest.mark.parametrize("kind", ["clusters", "three", "copies"])
def test_many_cells_give_the_edges_of_one(spark, kind, monkeypatch):
    x = points(kind)[::3]
    df, xs = frame(spark, x), [f"f{j}" for j in range(x.shape[1])]
    one = {tuple(r) for r in L.single_linkage(df, xs, "id", scale=False).collect()}
    monkeypatch.setattr(L, "CELL", 24)
    monkeypatch.setattr(L, "CHUNK", 100)
    many = L.single_linkage(df, xs, "id", scale=False).collect()
    assert np.allclose(sorted(r["height"] for r in many), brute_heights(x), rtol=1e-9, atol=1e-12)
    assert {tuple(r) for r in many} == one and len(many) == len(one)


def test_keys_may_be_texts(spark, monkeypatch):
    x = points("clusters")[::3]
    df = frame(spark, x).withColumn("id", F.concat(F.lit("k"), "id"))
    monkeypatch.setattr(L, "CELL", 24)
    rows = L.single_linkage(df, ["f0", "f1"], "id", scale=False).collect()
    assert all(r["a"] < r["b"] for r in rows)
    assert np.allclose(sorted(r["height"] for r in rows), brute_heights(x), rtol=1e-9, atol=1e-12)


def test_a_round_sends_a_row_to_few_cells(spark, monkeypatch):
    """Once every row was joined with the rows of each leaf near its own (some 20 in the plane), in every round."""
    n, sent = 6000, []
    x = np.random.default_rng(3).random((n, 2))
    monkeypatch.setattr(L, "CELL", 256)
    found = L._sent

    def counted(*args):
        out = found(*args)
        sent.append(out.count())
        return out

    monkeypatch.setattr(L, "_sent", counted)
    rows = L.single_linkage(frame(spark, x), ["f0", "f1"], "id", scale=False).collect()
    assert np.allclose(sorted(r["height"] for r in rows), brute_heights(x), rtol=1e-9, atol=1e-12)
    assert max(sent) <= n / 2 and sum(sent) <= 2 * n
