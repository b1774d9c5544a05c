"""S2 — Excel ``.xlsx`` workbooks as a Spark source.

A Python Data Source (``spark.read.format("xlsx")``): the driver only lists
the files matching the path glob; every workbook is one input partition, so
many workbooks are read in parallel by the executors.  Inside a task the
sheet XML is parsed as a stream (``iterparse``): memory holds the shared
strings table and one row at a time, not the sheet.  Only the cells of the
schema's columns are converted.  Where the session allows Python sources to take filters
(``spark.sql.python.filterPushdown.enabled``), comparisons of a column with a constant are
tested first, and the other cells of a row that fails are not converted.

Paths that are not mounted (``hdfs://``, object stores) are read through Spark's binary
files: each task gets whole workbooks (up to 2 GB each) from the file system of
their scheme and parses them the same way.

Cells are converted to the caller's schema, which is required: a workbook
carries no reliable types.  Supported cell kinds: numbers, shared strings, inline
strings, booleans, formula string results; dates may be ISO text or Excel
serial day numbers.  Legacy binary ``.xls`` is not supported.

:func:`write_xlsx` writes one workbook per partition of a DataFrame (same
minimal SpreadsheetML), used for round trips and tests.
"""

from __future__ import annotations

import datetime as dt
import glob
import io
import math
import operator
import os
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from itertools import chain, islice
from xml.etree.ElementTree import iterparse
from xml.sax.saxutils import escape

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
)

from tally.session import local_path, ship_package

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
BATCH_ROWS = 10_000  # rows a task hands over at a time
SHEET_ROWS = 1_048_575  # rows of a sheet below its header; the format has no more
_EXCEL_EPOCH = dt.datetime(1899, 12, 30)
_REF = re.compile(r"([A-Z]+)(\d+)")


class _Workbook(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def _col_index(ref: str) -> int:
    m = _REF.match(ref)
    letters = m.group(1) if m else "A"
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _sheets(zf: zipfile.ZipFile) -> list[tuple[str, str]]:
    """``(title, part)`` of every sheet in the workbook's order.  The part is
    found by the sheet's relationship; a workbook without relationships has
    its parts numbered in order."""
    with zf.open("xl/workbook.xml") as f:
        sheets = [(el.get("name"), el.get(f"{_REL}id")) for _, el in iterparse(f) if el.tag == f"{_NS}sheet"]
    targets = {}
    if "xl/_rels/workbook.xml.rels" in zf.namelist():
        with zf.open("xl/_rels/workbook.xml.rels") as f:
            targets = {el.get("Id"): el.get("Target") for _, el in iterparse(f) if el.get("Target")}
    out = []
    for i, (title, rid) in enumerate(sheets):
        target = targets.get(rid, f"worksheets/sheet{i + 1}.xml")
        out.append((title, target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")))
    return out


def _sheet_name(zf: zipfile.ZipFile, sheet: str | int) -> str:
    """The part of a sheet given by title, or by its place in the workbook."""
    sheets = _sheets(zf)
    for title, part in sheets:
        if title == sheet:
            return part
    if str(sheet).isdigit() and int(sheet) < len(sheets):
        return sheets[int(sheet)][1]
    raise ValueError(f"no sheet {sheet!r} among {[t for t, _ in sheets]}")


def _shared_strings(zf: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in zf.namelist():
        return []
    out = []
    with zf.open("xl/sharedStrings.xml") as f:
        for _, el in iterparse(f):
            if el.tag == f"{_NS}si":
                out.append("".join(t.text or "" for t in el.iter(f"{_NS}t")))
                el.clear()
    return out


def iter_rows(book, sheet: str | int = 0) -> Iterator[list]:
    """Raw cell values (str / float / bool / None) per row of one sheet of a workbook (a path or
    an open binary file)."""
    with zipfile.ZipFile(book) as zf:
        shared = _shared_strings(zf)
        with zf.open(_sheet_name(zf, sheet)) as f:
            parents = []
            for event, el in iterparse(f, ("start", "end")):
                if event == "start":
                    if el.tag == f"{_NS}sheetData":
                        parents.append(el)
                    continue
                if el.tag != f"{_NS}row":
                    continue
                row: dict[int, object] = {}
                for c in el.iter(f"{_NS}c"):
                    kind = c.get("t")
                    v = c.find(f"{_NS}v")
                    if kind == "inlineStr":
                        val = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                    elif v is None or v.text is None:
                        val = None
                    elif kind == "s":
                        val = shared[int(v.text)]
                    elif kind == "b":
                        val = v.text == "1"
                    elif kind in ("str", "e", "d"):
                        val = v.text
                    else:
                        val = float(v.text)
                    row[_col_index(c.get("r", "A1"))] = val
                for p in parents:
                    p.clear()  # or every row would stay attached to the sheet
                width = max(row) + 1 if row else 0
                yield [row.get(i) for i in range(width)]


def _convert(val, dtype: T.DataType):
    if val is None or val == "":
        return None
    try:
        if isinstance(dtype, T.StringType):
            if isinstance(val, float) and val.is_integer():
                return str(int(val))
            return str(val)
        if isinstance(dtype, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
            return int(float(val))
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            return float(val)
        if isinstance(dtype, T.BooleanType):
            return bool(val) if not isinstance(val, str) else val.strip().lower() in ("true", "1", "yes")
        if isinstance(dtype, (T.TimestampNTZType, T.TimestampType)):
            if isinstance(val, float):
                return _EXCEL_EPOCH + dt.timedelta(days=val)
            return dt.datetime.fromisoformat(str(val).strip())
        if isinstance(dtype, T.DateType):
            if isinstance(val, float):
                return (_EXCEL_EPOCH + dt.timedelta(days=val)).date()
            return dt.date.fromisoformat(str(val).strip()[:10])
    except (ValueError, TypeError, OverflowError):
        return None  # PERMISSIVE: an unparseable cell becomes NULL
    return val


_COMPARED = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge,
             LessThan: operator.lt, LessThanOrEqual: operator.le}


def _test(f: Filter, schema: T.StructType):
    """``(column, predicate)`` of a filter that compares a column with plain constants; None for
    others.  The predicate may keep a row that fails (Spark filters again), never drop one
    that passes: NaN, which Spark orders above all numbers, is always kept."""
    if isinstance(f, (IsNull, IsNotNull)):
        column, check = f.attribute, (lambda v: v is None) if isinstance(f, IsNull) else (lambda v: v is not None)
    elif isinstance(f, EqualNullSafe) and f.value is None:
        column, check = f.attribute, lambda v: v is None
    elif type(f) in _COMPARED or isinstance(f, (In, EqualNullSafe)):
        column, value = f.attribute, f.value
        if any(not isinstance(x, (int, float, str, bool)) for x in (value if isinstance(f, In) else [value])):
            return None
        compare = (lambda v, w: v in w) if isinstance(f, In) else _COMPARED.get(type(f), operator.eq)

        def check(v):
            return v is not None and (isinstance(v, float) and math.isnan(v) or compare(v, value))
    else:
        return None
    if len(column) != 1 or column[0] not in schema.names:
        return None
    if not isinstance(schema[column[0]].dataType, (T.StringType, T.IntegralType, T.DoubleType, T.BooleanType)):
        return None
    return column[0], check


def _read_sheet(book, schema: T.StructType, sheet: str | int, header: bool, tests: list = ()) -> Iterator[tuple]:
    """The rows of a workbook's sheet, converted to ``schema``."""
    fields = schema.fields
    rows = iter_rows(book, sheet)
    pos = list(range(len(fields)))
    if header:
        head = next(rows, None)
        if head is not None:
            names = [str(h) if h is not None else "" for h in head]
            pos = [names.index(f.name) if f.name in names else -1 for f in fields]
    first = [(pos[schema.names.index(c)], schema[c].dataType, check) for c, check in tests]

    def cell(r: list, i: int, dtype: T.DataType):
        return _convert(r[i] if 0 <= i < len(r) else None, dtype)

    for r in rows:
        if all(check(cell(r, i, dtype)) for i, dtype, check in first):
            yield tuple(cell(r, i, f.dataType) for i, f in zip(pos, fields))


class XlsxReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema = schema
        self.path = options.get("path")
        self.sheet = options.get("sheet", "0")
        self.header = str(options.get("header", "true")).lower() == "true"
        self.tests: list = []

    def partitions(self):
        path = local_path(self.path)
        if "://" in path:
            raise ValueError(f"{self.path}: workbooks are read with file calls; give a path that is mounted on all executors")
        files = sorted(glob.glob(path)) if any(ch in path for ch in "*?[") else (
            sorted(glob.glob(os.path.join(path, "*.xlsx"))) if os.path.isdir(path) else [path])
        return [_Workbook(f) for f in files]

    def read(self, partition: _Workbook | None):
        if partition is None:  # no workbook matches
            return iter(())
        return _read_sheet(partition.path, self.schema, self.sheet, self.header, self.tests)


class XlsxFilteringReader(XlsxReader):
    """A reader that skips rows by the query's filters (Spark asks for them only if the session allows it)."""

    def pushFilters(self, filters: list[Filter]):
        self.tests = [t for t in (_test(f, self.schema) for f in filters) if t]
        return filters  # Spark evaluates all of them again: skipping is only a saving


class XlsxDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self):
        raise ValueError("the xlsx source needs an explicit schema: spark.read.format('xlsx').schema(...)")

    def reader(self, schema: T.StructType) -> XlsxReader:
        return XlsxReader(schema, self.options)


class XlsxFilteringSource(XlsxDataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx_filtering"

    def reader(self, schema: T.StructType) -> XlsxReader:
        return XlsxFilteringReader(schema, self.options)


def register(spark: SparkSession) -> None:
    ship_package(spark)  # the reader runs in Python workers
    spark.dataSource.register(XlsxDataSource)
    spark.dataSource.register(XlsxFilteringSource)


def _read_bytes(spark: SparkSession, path: str, schema: T.StructType | str, sheet: str | int, header: bool) -> DataFrame:
    """Workbooks as binary files, whatever file system holds them."""
    ship_package(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("content")
    schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                rows = _read_sheet(io.BytesIO(content), schema, sheet, header)
                while part := list(islice(rows, BATCH_ROWS)):
                    yield pd.DataFrame({f.name: pd.Series([r[i] for r in part], dtype="object")
                                        for i, f in enumerate(schema.fields)})

    return files.mapInPandas(parse, schema)


def read_xlsx(spark: SparkSession, path: str, schema: T.StructType | str, sheet: str | int = 0,
              header: bool = True, as_bytes: bool | None = None) -> DataFrame:
    """Read every workbook matching ``path`` (a file, a folder or a glob).  ``as_bytes``
    reads them through Spark's file systems; unless given, so are paths that are not mounted."""
    if as_bytes if as_bytes is not None else "://" in local_path(path):
        return _read_bytes(spark, path, schema, sheet, header)
    register(spark)
    allowed = str(spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).lower() == "true"
    return (spark.read.format("xlsx_filtering" if allowed else "xlsx").schema(schema).option("sheet", str(sheet))
            .option("header", str(header).lower()).load(path))


# ---------------------------------------------------------------- writer
_CT = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
       '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
       '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
       '<Default Extension="xml" ContentType="application/xml"/>'
       '<Override PartName="/xl/workbook.xml" '
       'ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
       '<Override PartName="/xl/worksheets/sheet1.xml" '
       'ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
_RELS = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
         '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
         '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/'
         'officeDocument" Target="xl/workbook.xml"/></Relationships>')
_WB = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
       '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
       'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
       '<sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>')
_WB_RELS = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/'
            'worksheet" Target="worksheets/sheet1.xml"/></Relationships>')


def _col_letters(i: int) -> str:
    s = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


def _cell(ref: str, v) -> str:
    if v is None or (isinstance(v, float) and v != v):
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f'<c r="{ref}"><v>{repr(float(v)) if isinstance(v, float) else v}</v></c>'
    if isinstance(v, (dt.datetime, pd.Timestamp)):
        v = pd.Timestamp(v).isoformat(sep=" ")
    return f'<c r="{ref}" t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'


def _sheet_xml(columns: list[str], rows) -> Iterator[str]:
    yield ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
           '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
    yield '<row r="1">' + "".join(_cell(f"{_col_letters(i)}1", c) for i, c in enumerate(columns)) + "</row>"
    for n, r in enumerate(rows, start=2):
        yield f'<row r="{n}">' + "".join(_cell(f"{_col_letters(i)}{n}", v) for i, v in enumerate(r)) + "</row>"
    yield "</sheetData></worksheet>"


def write_xlsx(df: DataFrame, folder: str, sheet_rows: int = SHEET_ROWS) -> str:
    """Write one workbook per partition of ``df`` into ``folder`` (in
    parallel, from the executors) and return the folder.  A partition of more
    than ``sheet_rows`` rows goes on in further workbooks; rows are written as they
    come, so a task holds one batch of its partition."""
    ship_package(df.sparkSession)
    cols = df.columns
    target_dir = local_path(folder)
    if "://" in target_dir:
        raise ValueError(f"{folder}: workbooks are written with file calls; give a folder that is mounted on all executors")

    def write_book(target: str, rows: Iterator[tuple]) -> int:
        tmp = f"{target}.{uuid.uuid4().hex}.tmp"
        n = 0

        def counted():
            nonlocal n
            for r in rows:
                n += 1
                yield r

        with zipfile.ZipFile(tmp, "w", zipfile.ZIP_DEFLATED) as zf:
            zf.writestr("[Content_Types].xml", _CT)
            zf.writestr("_rels/.rels", _RELS)
            zf.writestr("xl/workbook.xml", _WB)
            zf.writestr("xl/_rels/workbook.xml.rels", _WB_RELS)
            with zf.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
                for chunk in _sheet_xml(cols, counted()):
                    f.write(chunk.encode("utf-8"))
        os.replace(tmp, target)  # atomic: readers never see a half-written workbook
        return n

    def write_part(batches):
        rows = (tuple(None if pd.isna(v) else v for v in rec)
                for b in batches for rec in b.itertuples(index=False, name=None))
        os.makedirs(target_dir, exist_ok=True)
        # named by partition: a retried or speculative attempt replaces the
        # same workbooks instead of adding duplicates
        name, book = f"part-{TaskContext.get().partitionId():05d}", 0
        while (head := next(rows, None)) is not None:
            target = os.path.join(target_dir, f"{name}-{book}.xlsx" if book else f"{name}.xlsx")
            n = write_book(target, chain([head], islice(rows, sheet_rows - 1)))
            yield pd.DataFrame({"file": [target], "rows": [n]})
            book += 1

    df.mapInPandas(write_part, "file string, rows long").collect()  # one row per written file
    return folder
