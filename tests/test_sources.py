"""Sources, sinks, encoding and streaming beyond the SQL-twin round trips."""

import datetime as dt
import os
import zipfile

from pyspark.sql import functions as F

from conftest import SF_TINY
from tally.operators import clean as K
from tally.operators import timeseries as TS
from tally.session import local_path, scratch_path
from tally.sources.files import export_table, read_csv, read_table
from tally.sources.xlsx import read_xlsx, write_xlsx


def test_xlsx_round_trip_with_nulls(spark):
    df = spark.createDataFrame(
        [(1, "a & <b>", 1.5, dt.datetime(2024, 1, 2, 3, 4, 5), True),
         (2, None, None, None, None), (3, "ü", -2.25, dt.datetime(1999, 12, 31), False)],
        "id bigint, s string, x double, t timestamp_ntz, b boolean").repartition(2)
    folder = write_xlsx(df, scratch_path(spark, "xlsx-test"))
    back = read_xlsx(spark, folder, df.schema)
    assert sorted(back.collect()) == sorted(df.collect())
    # rewriting the same partitions replaces files instead of adding copies
    write_xlsx(df, folder)
    assert read_xlsx(spark, folder, df.schema).count() == 3


def _workbook_with_shared_strings(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rel}><sheets><sheet name="First" sheetId="1" r:id="rId1"/>'
                                      f'<sheet name="Data" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f'<sst {ns}><si><t>name</t></si><si><t>value</t></si>'
                                           f'<si><t>alpha</t></si><si><r><t>be</t></r><r><t>ta</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData/></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {ns}><sheetData>'
                   '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>'
                   '<row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2"><v>45292</v></c></row>'
                   '<row r="3"><c r="A3" t="s"><v>3</v></c></row>'
                   '</sheetData></worksheet>')


def test_xlsx_shared_strings_sheet_by_name_and_serial_dates(spark):
    folder = scratch_path(spark, "xlsx-ss")
    os.makedirs(local_path(folder))
    _workbook_with_shared_strings(os.path.join(local_path(folder), "book.xlsx"))
    rows = read_xlsx(spark, folder, "name string, value timestamp_ntz", sheet="Data").collect()
    assert sorted((r["name"], r["value"]) for r in rows) == [("alpha", dt.datetime(2024, 1, 1)), ("beta", None)]


def test_csv_keeps_corrupt_records(spark):
    path = scratch_path(spark, "bad-csv")
    os.makedirs(local_path(path))
    with open(os.path.join(local_path(path), "a.csv"), "w") as f:
        f.write("k,v\n1,2.5\n2,oops\n")
    rows = sorted(read_csv(spark, path, "k int, v double", corrupt_column="_bad").collect())
    assert rows[0]["v"] == 2.5 and rows[0]["_bad"] is None
    assert rows[1]["v"] is None and rows[1]["_bad"] == "2,oops"


def test_export_refuses_to_overwrite_by_default(spark):
    df = read_table(spark, SF_TINY, "nation")
    path = export_table(df, scratch_path(spark, "nation"), "json")
    try:
        export_table(df, path, "json")
        raised = False
    except Exception:  # noqa: BLE001 - AnalysisException: path exists
        raised = True
    assert raised
    export_table(df, path, "json", mode="overwrite")


def test_onehot_vectors(spark):
    o = read_table(spark, SF_TINY, "orders")
    out = K.encode(o, ["o_orderstatus"], "onehot").select("o_orderstatus", "o_orderstatus_idx", "o_orderstatus_vec")
    for r in out.limit(50).collect():
        v = r["o_orderstatus_vec"].toArray()
        assert v.sum() == 1.0 and v[int(r["o_orderstatus_idx"])] == 1.0


def test_streaming_daily_resample_equals_batch(spark):
    from tally.streaming import resample_stream, run_to_table, stream_table
    res = resample_stream(stream_table(spark, SF_TINY, "events"), "ts", "value", "day", "sum")
    got = spark.read.parquet(run_to_table(spark, res, "events-daily"))
    want = TS.resample(read_table(spark, SF_TINY, "events"), "ts", "value", "day", "sum")
    g = {r["ts"]: r["y"] for r in got.collect()}
    w = {r["ts"]: r["y"] for r in want.collect()}
    assert g.keys() == w.keys()
    assert all(abs(g[k] - w[k]) <= 1e-9 * max(1.0, abs(w[k])) for k in w)


def test_sample_table_columns(spark):
    from tally.sources.files import sample_table
    s = sample_table(spark, 100)
    assert s.columns == ["id", "ts", "category", "x", "y", "flag"]
    assert s.agg(F.countDistinct("category")).first()[0] == 5


def test_shipped_package_contains_the_modules(spark):
    import glob

    from tally import session
    session._SHIPPED.discard(spark.sparkContext.applicationId)
    session.ship_package(spark)
    zips = glob.glob(os.path.join(local_path(session.ensure_checkpoint_dir(spark)), "tally-scratch", "pyfiles-*",
                                  "tally.zip"))
    assert zips
    names = zipfile.ZipFile(sorted(zips, key=os.path.getmtime)[-1]).namelist()
    for m in ("tally/__init__.py", "tally/operators/timeseries.py", "tally/sources/xlsx.py", "tally/session.py"):
        assert m in names
