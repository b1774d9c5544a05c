"""Cases that earlier versions got wrong: text through CSV and Excel, gaps and
NULL keys in time series, other positive classes, keys numbered in steps,
polynomials of a large x."""

import datetime as dt
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tally.operators import evaluate as M
from tally.operators import regress as R
from tally.operators import timeseries as TS
from tally.session import local_path, scratch_path
from tally.sources.files import export_table, read_back, read_csv
from tally.sources.xlsx import read_xlsx

TRICKY = ['plain', 'a,b;c', 'say "hi"', 'two\nlines', 'tab\there', ' lead and trail ', '', None, '한국어', '\\n \\" back\\', '"', ';', 'NA?']


def test_csv_keeps_text(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TRICKY)], "id int, t string")
    back = read_back(spark, export_table(df, scratch_path(spark, "tricky"), "csv"), "csv", df.schema)
    assert dict(map(tuple, back.collect())) == dict(enumerate(TRICKY))
    path = export_table(df, scratch_path(spark, "tricky"), "csv", sep=";", encoding="CP949", null_value="NA")
    back = read_csv(spark, path, df.schema, sep=";", encoding="CP949", null_value="NA")
    assert dict(map(tuple, back.collect())) == dict(enumerate(TRICKY))


def test_csv_infers_from_all_rows(spark):
    path = scratch_path(spark, "late-type")
    os.makedirs(local_path(path))
    with open(os.path.join(local_path(path), "a.csv"), "w") as f:
        f.write("k,v\n" + "".join(f"{i},{i}\n" for i in range(3000)) + "3000,later\n")
    df = read_csv(spark, path)
    assert dict(df.dtypes)["v"] == "string" and df.where("v is null").count() == 0


def test_xlsx_sheet_by_relationship(spark):
    folder = scratch_path(spark, "xlsx-rel")
    os.makedirs(local_path(folder))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'

    def sheet(v):
        return (f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>v</t></is></c></row>'
                f'<row r="2"><c r="A2" t="d"><v>{v}</v></c></row></sheetData></worksheet>')

    with zipfile.ZipFile(os.path.join(local_path(folder), "b.xlsx"), "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rel}><sheets><sheet name="B" sheetId="2" r:id="x2"/>'
                                      f'<sheet name="A" sheetId="1" r:id="x1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="x1" Target="worksheets/sheet1.xml"/><Relationship Id="x2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet("2020-01-01"))
        z.writestr("xl/worksheets/sheet2.xml", sheet("2020-02-02"))
    got = {s: read_xlsx(spark, folder, "v timestamp_ntz", sheet=s).first()["v"] for s in ("A", "B", 0, 1)}
    a, b = dt.datetime(2020, 1, 1), dt.datetime(2020, 2, 2)
    assert got == {"A": a, "B": b, 0: b, 1: a}


def series(spark, gaps=(), key="k"):
    rows = [(key, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), 100.0 + 2 * i + 10 * (i % 7)) for i in range(70) if i not in gaps]
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, y double")


@pytest.mark.parametrize("key", ["k", None])
def test_gaps_do_not_shift_what_follows(spark, key):
    g = series(spark, gaps={30}, key=key)
    dec = TS.decompose(g, "ts", "day", 7, by=["k"]).where("resid is not null").collect()
    assert len(dec) > 50 and max(abs(r["resid"]) for r in dec) < 1e-9
    t = TS.linear_trend(g, "ts", "day", by=["k"]).first()
    assert t["n"] == 69 and abs(t["slope"] - 2) < 0.2
    for method in ("trend_season", "holt_winters", "ar", "seasonal_naive", "drift"):
        f = TS.forecast(g, "ts", 7, method, "day", period=7, p=7, by=["k"]).collect()
        assert sorted(r["step"] for r in f) == list(range(1, 8)), method
        if method in ("trend_season", "ar"):
            assert all(abs(r["yhat"] - (100 + 2 * (69 + r["step"]) + 10 * ((69 + r["step"]) % 7))) < 1e-6 for r in f), method
    assert TS.backtest(g, "ts", 7, "trend_season", "day", period=7, by=["k"]).first()["mae"] < 1e-6
    hw = TS.holt_winters(g, "ts", 7, horizon=2, freq="day", by=["k"]).collect()
    assert len(hw) == 72 and sum(r["y"] is None for r in hw) == 3
    filled = TS.fill_gaps(g, "ts", "day", "zero", by=["k"])
    assert filled.where("filled").count() == 1 and filled.count() == 70
    lag = {r["ts"].timetuple().tm_yday: r["lag_1"] for r in TS.lag_features(g, "ts", "day", [1], by=["k"]).collect()}
    assert lag[32] is None and lag[33] == 100.0 + 62 + 10 * (31 % 7)


def test_short_series_say_why(spark):
    g = series(spark).where("ts < '2024-01-06'").union(series(spark, key=None).where("ts < '2024-01-03'"))
    for method in ("holt_winters", "ar"):
        f = TS.forecast(g, "ts", 3, method, "day", period=7, p=3, by=["k"]).collect()
        assert len(f) == 6 and all(r["yhat"] is None and r["reason"] for r in f)
    assert all(r["yhat"] is not None for r in TS.holt_winters(g, "ts", 1, horizon=2, freq="day", by=["k"])
               .where("step > 0").select(F.col("fitted").alias("yhat")).collect())


def test_searched_smoothing_fits_at_least_as_well(spark):
    g = series(spark).withColumn("y", F.col("y") + F.sin("y") * 9)

    def sse(**p):
        return TS.holt_winters(g, "ts", 7, freq="day", by=["k"], **p).agg(F.sum((F.col("y") - F.col("fitted")) ** 2)).first()[0]

    assert sse(alpha=None, beta=None, gamma=None) <= sse(alpha=0.3, beta=0.1, gamma=0.2) + 1e-9


def test_other_positive_class(spark):
    df = spark.range(400).select(((F.col("id") * 37) % 100).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("z"))
    df = df.withColumn("label", (F.col("x") + F.col("z") > 50).cast("double"))
    auc = {p: M.compare_classifiers(df, df, "label", ["x", "z"], models=["logistic"], positive=p).first()["auc"] for p in (0.0, 1.0)}
    assert auc[0.0] > 0.95 and abs(auc[0.0] - auc[1.0]) < 1e-9


def test_folds_of_keys_in_steps(spark):
    df = spark.range(300).select((F.col("id") * 5).alias("key"), (F.col("id") % 17).cast("double").alias("x"))
    df = df.withColumn("y", 2 * F.col("x") + 1).withColumn("c", (F.col("x") > 8).cast("double"))
    folds = M.cross_validate(df, "y", ["x"], k=5, key="key").collect()
    assert len(folds) == 5 and all(r["n_test"] + r["n_train"] == 300 and r["r2"] > 0.999 for r in folds)
    assert all(r["accuracy"] == 1.0 for r in M.cross_validate(df, "c", ["x"], k=5, key="key", model="decision_tree", classify=True).collect())
    share = R.split(df, "key").agg(F.avg(F.col("is_test").cast("double"))).first()[0]
    assert 0.1 < share < 0.3


def test_polynomial_of_a_large_x(spark):
    x = np.linspace(100_000, 101_000, 400)
    y = 1e-6 * (x - 100_500) ** 3 - 2e-3 * (x - 100_500) ** 2 + 5 + np.sin(x)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    model, names = R.fit_linear(df, "y", ["x"], degree=3)
    mse = R.regression_metrics(R.predict(model, df, "y", ["x"], degree=3)).first()["mse"]
    z = (x - x.mean()) / x.std()
    best = np.mean((np.polyval(np.polyfit(z, y, 3), z) - y) ** 2)
    assert mse == pytest.approx(best, rel=1e-6)
    assert [r["term"] for r in R.coefficients(model, names).collect()] == ["intercept", "x", "x^2", "x^3"]


def test_permutation_does_not_depend_on_the_layout(spark):
    df = spark.range(500).select("id", (F.col("id") % 13).alias("v"))
    one = {r["id"]: r["v"] for r in M.permute_column(df.repartition(1), "v", key=["id"]).collect()}
    many = {r["id"]: r["v"] for r in M.permute_column(df.repartition(9), "v", key=["id"]).collect()}
    assert one == many and sorted(one.values()) == sorted(i % 13 for i in range(500))


def test_forest_reads_its_rows_once(spark):
    """A fit makes several passes; the rows under it are computed once."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = spark.range(400).selectExpr("double(id % 7) AS a", "double(id % 5) AS b", "double(id % 7 > 3) AS label")
    model = M.fit_forest(rows.mapInArrow(counted, rows.schema), "label", ["a", "b"])
    assert read.value == 400
    assert M.feature_importance(model, ["a", "b"]).orderBy("importance").collect()[-1]["feature"] == "a"


def test_ranks_return_to_their_rows_without_lists(spark):
    """Average ranks of tied columns, each in its column's place, from aggregates that need no sorted lists."""
    from tally.operators.profile import _rank_vectors
    rows = spark.createDataFrame([(3.0, 1.0), (1.0, 1.0), (2.0, 5.0), (3.0, 0.0), (None, 9.0)], "a double, b double")
    ranks = _rank_vectors(rows, ["a", "b"])
    assert sorted(tuple(r["_v"]) for r in ranks.collect()) == [(1.0, 2.5), (2.0, 4.0), (3.5, 1.0), (3.5, 2.5)]
    assert "collect_list" not in ranks._jdf.queryExecution().optimizedPlan().toString()
