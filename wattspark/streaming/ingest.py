"""Line-protocol files -> typed rows -> day-partitioned table; windowed power.

The stream reads text files as they land (``readStream.text``), parses them
with the batch parser (A16), and writes parquet partitioned by day with a
checkpoint in the shared checkpoint folder, so a restarted or failed query
resumes exactly where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wattspark.sources.formats import parse_line_protocol, field_double

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def enable_rocksdb(spark: SparkSession) -> None:
    """Keyed state in RocksDB (off-heap, incremental checkpoints): required by the
    transformWithState operators and better for large windowed state."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def read_line_protocol_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream of parsed line-protocol rows: measurement, tags, fields, time."""
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return parse_line_protocol(r.load(path), "value")


def power_rows(parsed: DataFrame, host_tag: str = "host", field: str = "value") -> DataFrame:
    """Typed power samples from parsed rows: timestamp, host, value."""
    return parsed.select(F.col("time").alias("timestamp"), F.col("tags")[host_tag].alias("host"),
                         field_double("fields", field).alias("value"))


def ingest(parsed: DataFrame, out_path: str, checkpoint: str, ts_col: str = "time",
           trigger_available_now: bool = True):
    """Append parsed rows to a day-partitioned parquet table. Returns the StreamingQuery."""
    d = parsed.withColumn("timestamp_day", F.to_date(F.col(ts_col)))
    w = (d.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint)
          .partitionBy("timestamp_day").outputMode("append"))
    w = w.trigger(availableNow=True) if trigger_available_now else w
    return w.start()


def tumbling_power(samples: DataFrame, every: str = "10 minutes", watermark: str = "10 minutes",
                   keys=()) -> DataFrame:
    """Mean and count of power per epoch-aligned window (append mode: a window is
    emitted once the watermark passes its end)."""
    # event time must be TIMESTAMP for a watermark; UTC session -> same instants
    s = samples.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", watermark)
    g = s.groupBy(F.window("timestamp", every).alias("w"), *keys)
    return g.agg(F.avg("value").alias("mean_W"), F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "mean_W", "n")
