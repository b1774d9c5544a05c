"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tally.session import scratch_path, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the
    lineage, survives lost executors, computes the plan a single time."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a frame that ``materialize`` returned."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tally-scratch/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that are done.  It does so once the driver's JVM has
    collected their plans, which in an operator of many steps may be long after the next ones wrote theirs."""
    spark.range(1).count()  # the last job's plan is held until there is another
    spark.sparkContext._jvm.System.gc()


def text_or_empty(c: str | Column = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).cast("string")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, wherever the optimizer puts it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_python(df: DataFrame) -> DataFrame:
    """Make this package importable in Python workers before a Python stage."""
    ship_package(df.sparkSession)
    return df


def field(schema: T.StructType, name: str) -> T.DataType:
    return schema[name].dataType
