"""T1 (time-slot trend) on a stream.

The same aggregate as ``operators.timeseries.resample`` for fixed-length
steps (hour, day, week): an event-time tumbling window with a watermark, so
late rows within the watermark still land in their window and state for
closed windows can be dropped.  Calendar steps (month, quarter, year) have
no fixed length and are not supported by ``window``; use the batch form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tally.operators.charts import agg_expr
from tally.session import scratch_path

DURATIONS = {"hour": "1 hour", "day": "1 day", "week": "7 days"}


def _epoch_ntz():
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def stream_table(spark: SparkSession, sf_dir: str, name: str, max_files: int = 1) -> DataFrame:
    """A given Parquet table as a file stream (schema taken from the batch
    reader; a stream needs it up front)."""
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").schema
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
            .option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir))


def resample_stream(stream: DataFrame, ts: str, y: str | None, freq: str, agg: str = "sum",
                    watermark: str = "1 hour") -> DataFrame:
    """Streaming ``(ts, y)`` per tumbling window of ``freq``."""
    if freq not in DURATIONS:
        raise ValueError(f"streaming resample supports {sorted(DURATIONS)}, not {freq!r}")
    ntz = isinstance(stream.schema[ts].dataType, T.TimestampNTZType)
    # watermarks need an instant (LTZ); map wall-clock NTZ values to instants
    # by epoch arithmetic, independent of the session time zone, so windows
    # fall on wall-clock hour / day boundaries
    ev = F.timestamp_micros(F.timestamp_diff("MICROSECOND", _epoch_ntz(), F.col(ts))) if ntz else F.col(ts)
    out = (stream.withColumn("_event", ev).withWatermark("_event", watermark)
           .groupBy(F.window(F.col("_event"), DURATIONS[freq]).alias("_w"))
           .agg(agg_expr(agg, y).cast("double").alias("y")))
    start = (F.timestamp_add("MICROSECOND", F.unix_micros(F.col("_w.start")), _epoch_ntz()) if ntz
             else F.col("_w.start"))
    return out.select(start.alias(ts), "y")


def run_to_table(spark: SparkSession, result: DataFrame, name: str) -> str:
    """Run a streaming aggregate over everything available (trigger
    availableNow) and return the path of its table in the shared checkpoint
    folder.

    Update mode: a micro-batch writes only the windows it changed, into a
    folder of its own (an overwrite, so a replayed micro-batch is harmless),
    and windows that the watermark has closed leave the state.  The table is
    the last version of every window.  The query checkpoint lets a restarted
    driver resume."""
    changes, out = scratch_path(spark, f"{name}-changes"), scratch_path(spark, f"{name}-table")
    ckpt = scratch_path(spark, f"{name}-checkpoint")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changes}/epoch={epoch}")

    q = (result.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    keys = [c for c in result.columns if c != "y"]
    (spark.read.option("basePath", changes).parquet(changes).groupBy(*keys)
     .agg(F.max_by(F.struct("y"), "epoch").alias("r")).select(*keys, F.col("r.y").alias("y")).write.parquet(out))
    return out
