"""Table sources and sinks (S1, S3, S4, X1).

Data come by path.  Schemas are passed explicitly wherever possible:
``inferSchema`` costs a full extra pass over the files and guesses ``int``
for small integers and ``timestamp`` for time-zone-less text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """S4 — one Parquet table; the scan takes pushed filters and pruned columns."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_CHARSETS = {"iso-8859-1", "us-ascii", "utf-8", "utf-16", "utf-16be", "utf-16le", "utf-32"}


def _allow_charset(spark: SparkSession, encoding: str) -> None:
    """Spark takes character sets beyond its short list (CP949, Shift_JIS, ...)
    only where the session says so; the setting stays on for the session."""
    if encoding.lower() not in _CHARSETS:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def _csv_options(sep: str, encoding: str, null_value: str, multi_line: bool) -> dict:
    """Quotes inside a field are doubled, white space is kept, and an empty
    string (quoted) stays apart from NULL: what other programs write and read."""
    return {"sep": sep, "encoding": encoding, "quote": '"', "escape": '"', "nullValue": null_value, "emptyValue": "",
            "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "multiLine": multi_line}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             sampling: float = 1.0, header: bool = True, corrupt_column: str | None = None,
             sep: str = ",", encoding: str = "UTF-8", null_value: str = "", multi_line: bool = True) -> DataFrame:
    """S1 — CSV with a header row.

    With a schema: one pass, malformed fields become NULL (PERMISSIVE); if
    ``corrupt_column`` is given the raw line of a bad record is kept there.
    Without a schema: types are inferred from a ``sampling`` share of rows
    (all by default; a smaller share can turn later values into NULL).

    ``multi_line`` lets quoted fields hold line breaks; a file is then one
    input partition.  Set it to False for large files without them, which
    Spark may split.  ``encoding`` is the files' character set (``CP949``,
    ``ISO-8859-1``, ...), ``null_value`` the text that stands for NULL.
    """
    _allow_charset(spark, encoding)
    # a field that is empty and not quoted is NULL; a mark that no file holds keeps "" apart from it
    options = _csv_options(sep, encoding, null_value or "\x00", multi_line)
    reader = spark.read.options(header=header, mode="PERMISSIVE", **options)
    if multi_line:
        reader = reader.option("lineSep", "\n")
    if schema is not None:
        if corrupt_column:
            if isinstance(schema, str):
                schema = T._parse_datatype_string(schema)
            schema = T.StructType(list(schema.fields) + [T.StructField(corrupt_column, T.StringType())])
            reader = reader.option("columnNameOfCorruptRecord", corrupt_column)
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", True).option("samplingRatio", sampling)
    return reader.csv(path)


def sample_table(spark: SparkSession, n: int = 1000, seed: int = 0,
                 partitions: int | None = None) -> DataFrame:
    """S3 — a built-in sample table computed from ``id`` alone (no ``rand``),
    so the same rows come out on every run and partitioning.

    Columns: id, ts (hourly from 2024-01-01), category (5 values), x, y (a
    noisy linear function of x), flag (0/1).
    """
    h = F.xxhash64(F.col("id"), F.lit(seed))
    u1 = F.pmod(h, F.lit(1_000_003)) / F.lit(1_000_003.0)
    u2 = F.pmod(F.xxhash64(F.col("id"), F.lit(seed + 1)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    base = spark.range(0, n, 1, partitions) if partitions else spark.range(0, n)
    return base.select(
        F.col("id"),
        F.timestamp_add("HOUR", F.col("id"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("ts"),
        F.element_at(F.array(*[F.lit(c) for c in ("A", "B", "C", "D", "E")]),
                     (F.pmod(F.col("id"), F.lit(5)) + 1).cast("int")).alias("category"),
        (u1 * 100.0).alias("x"),
        (u1 * 250.0 + 10.0 + u2 * 20.0).alias("y"),
        (u2 > 0.5).cast("int").alias("flag"),
    )


def export_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists",
                 single_file: bool = False, header: bool = True, sep: str = ",", encoding: str = "UTF-8",
                 null_value: str = "") -> str:
    """X1 — write a result table.  CSV fields with separators, quotes or line
    breaks are quoted, quotes doubled; ``read_csv`` and ``read_back`` give the
    same rows again.

    Written in parallel, one file per partition.  ``single_file=True`` is for
    bounded chart tables only (it funnels the rows through one task).
    """
    fmt = fmt.lower()
    if fmt not in ("parquet", "csv", "json"):
        raise ValueError(f"unsupported format {fmt!r}")
    out = df.coalesce(1) if single_file else df
    writer = out.write.mode(mode).format(fmt)
    if fmt == "csv":
        _allow_charset(df.sparkSession, encoding)
        options = _csv_options(sep, encoding, null_value, False)
        del options["multiLine"]
        options["emptyValue"] = '""'
        writer = writer.options(header=header, **options)
    writer.save(path)
    return path


def read_back(spark: SparkSession, path: str, fmt: str, schema: T.StructType) -> DataFrame:
    """Read what :func:`export_table` wrote, with the original schema."""
    if fmt == "csv":
        return read_csv(spark, path, schema)
    return spark.read.schema(schema).format(fmt).load(path)
