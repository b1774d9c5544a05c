"""Workbooks: filters taken by the reader, any file system, sheets that fill up."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNull, Not

from tally.session import local_path, scratch_path
from tally.sources import xlsx
from tally.sources.xlsx import read_xlsx, write_xlsx

SCHEMA = "id bigint, s string, x double, t timestamp_ntz, b boolean, d date"


def _table(spark):
    rows = [(i, None if i % 5 == 0 else f"s{i % 3}", None if i % 7 == 0 else i / 4, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i),
             None if i % 11 == 0 else i % 2 == 0, dt.date(2024, 1, 1) + dt.timedelta(days=i)) for i in range(200)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "id")


@pytest.fixture
def folder(spark):
    return write_xlsx(_table(spark), scratch_path(spark, "xlsx-filters"))


CONDITIONS = ["id > 150", "s = 's1'", "x <= 3.5 AND s IS NOT NULL", "s IS NULL", "b", "id IN (3, 4, 500)", "id = 7 OR id = 9",
              "s <=> NULL", "s <=> 's2'", "NOT (id < 190)", "t >= TIMESTAMP_NTZ'2024-01-08 00:00:00'", "s LIKE 's%' AND id < 20",
              "d = DATE'2024-01-05'", "id + 1 > 195", "x IS NULL AND id >= 100"]


def test_filters_give_the_same_rows(spark, folder):
    want = {c: sorted(map(str, _table(spark).where(c).collect())) for c in CONDITIONS}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        for c in CONDITIONS:
            assert sorted(map(str, read_xlsx(spark, folder, SCHEMA).where(c).collect())) == want[c], c
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    for c in CONDITIONS[:3]:
        assert sorted(map(str, read_xlsx(spark, folder, SCHEMA).where(c).collect())) == want[c], c


def test_rows_that_fail_are_not_converted(spark, folder, monkeypatch):
    book = next(os.path.join(local_path(folder), f) for f in sorted(os.listdir(local_path(folder))) if f.endswith(".xlsx"))
    schema = spark.createDataFrame([], SCHEMA).schema
    seen = []
    convert = xlsx._convert
    monkeypatch.setattr(xlsx, "_convert", lambda v, t: seen.append(t) or convert(v, t))
    reader = xlsx.XlsxFilteringReader(schema, {"path": book})
    filters = [GreaterThan(("id",), 1_000), Not(EqualTo(("s",), "s1"))]
    assert list(reader.pushFilters(filters)) == filters and len(reader.tests) == 1
    assert list(reader.read(xlsx._Workbook(book))) == []
    assert seen and {t.typeName() for t in seen} == {"long"}  # one cell a row
    # what cannot be told by a plain comparison is left to Spark
    assert xlsx._test(EqualTo(("t",), dt.datetime(2024, 1, 1)), schema) is None
    assert xlsx._test(EqualTo(("s", "part"), "x"), schema) is None and xlsx._test(IsNull(("none",)), schema) is None
    column, check = xlsx._test(GreaterThan(("x",), 5.0), schema)
    assert column == "x" and check(float("nan")) and not check(None) and not check(5.0)
    assert xlsx._test(In(("id",), (1, 2)), schema)[1](2)


def test_any_file_system_and_part_of_the_columns(spark, folder):
    want = sorted(map(str, _table(spark).collect()))
    assert sorted(map(str, read_xlsx(spark, folder, SCHEMA, as_bytes=True).collect())) == want
    part = read_xlsx(spark, folder, "x double, none string, id long", as_bytes=True)
    assert part.columns == ["x", "none", "id"] and part.where("none is null").count() == 200
    assert part.agg(F.sum("id")).first()[0] == sum(range(200))


def test_full_sheets_go_on_in_further_workbooks(spark):
    folder = write_xlsx(_table(spark), scratch_path(spark, "xlsx-many"), sheet_rows=25)
    names = [f for f in os.listdir(local_path(folder)) if f.endswith(".xlsx")]
    assert len(names) >= 8 and not [f for f in os.listdir(local_path(folder)) if f.endswith(".tmp")]
    for as_bytes in (False, True):
        assert sorted(map(str, read_xlsx(spark, folder, SCHEMA, as_bytes=as_bytes).collect())) == sorted(map(str, _table(spark).collect()))


def test_tables_without_rows(spark):
    folder = write_xlsx(_table(spark).where("id < 0"), scratch_path(spark, "xlsx-none"))
    os.makedirs(local_path(folder), exist_ok=True)
    assert read_xlsx(spark, folder, SCHEMA).count() == 0 and read_xlsx(spark, folder, SCHEMA, as_bytes=True).count() == 0
