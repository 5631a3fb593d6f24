"""PUE on closed buckets from streams of meter and PDU samples.

Two forms. ``stream_pue`` is one append-mode query: each side is a watermarked windowed
aggregate (the PDU side two of them, mean per outlet, then their sum), and the sides are joined on the window. A
bucket is emitted once, when the watermark passes its end; Spark's checkpoint carries all of it over a restart.

``partials_writer`` keeps mergeable partial aggregates (sum and count per bucket and device/port) in a snapshot
table: each micro-batch is one load with its batch id as token, so a replayed batch is not
loaded twice, and partials merge exactly, so any batching gives the batch result. Every ``compact_every`` batches the
partials are merged into one row per bucket, device and port: reads fold a bounded number of loads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wattspark.functions.timecols import bucket_start
from wattspark.sources.snapshots import SnapshotTable

PARTIAL_KEYS = ["bucket", "kind", "device", "port"]


def stream_pue(meter: DataFrame, pdu: DataFrame, every: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """``timestamp, meter_W, pdu_W, ratio`` per closed bucket. ``meter``: ``timestamp, value``; ``pdu``: ``timestamp, device, port, value``,
    both streams; a sample may arrive ``delay`` behind the newest one of its stream."""
    def timed(s: DataFrame) -> DataFrame:
        return s.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", delay)

    site = timed(meter).groupBy(F.window("timestamp", every)).agg(F.avg("value").alias("meter_W"))
    outlets = timed(pdu).groupBy(F.window("timestamp", every), "device", "port").agg(F.avg("value").alias("mean_W"))
    racks = outlets.groupBy(F.window(F.window_time("window"), every)).agg(F.sum("mean_W").alias("pdu_W"))
    return site.join(racks, "window").select(F.col("window.start").alias("timestamp"), "meter_W", "pdu_W", F.try_divide("meter_W", "pdu_W").alias("ratio"))


def merged(partials: DataFrame) -> DataFrame:
    """One partial per bucket, device and port."""
    return partials.groupBy(*PARTIAL_KEYS).agg(F.sum("s").alias("s"), F.sum("c").alias("c"), F.max("max_ts").alias("max_ts"))


def partials_writer(state_path: str, every_s: int = 600, compact_every: int = 50):
    """foreachBatch function: loads the batch's partials into the snapshot table at ``state_path``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        one = batch.select(bucket_start("timestamp", every_s).alias("bucket"), "kind", "device", "port", F.col("value").alias("s"), F.lit(1).cast("long").alias("c"), F.col("timestamp").alias("max_ts"))
        table = SnapshotTable(batch.sparkSession, state_path)
        table.load(merged(one), token=f"batch-{batch_id}")
        if len(table.entry()["loads"]) >= compact_every:
            table.compact(merged(table.read()))
    return write


def pue_from_partials(spark: SparkSession, state_path: str, every_s: int = 600,
                      lateness_s: int = 600) -> DataFrame:
    """(timestamp, ratio) for buckets closed by max event time - lateness."""
    p = merged(SnapshotTable(spark, state_path).read())
    mean = p.withColumn("mean", F.col("s") / F.col("c"))
    meter = mean.where(F.col("kind") == "meter").select("bucket", F.col("mean").alias("meter_W"))
    pdu = mean.where(F.col("kind") == "pdu").groupBy("bucket").agg(F.sum("mean").alias("pdu_W"))
    wm = p.select(F.max("max_ts")).scalar()
    closed = (F.col("bucket").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
              F.lit(float(every_s)))) <= (wm.cast("timestamp") - F.make_dt_interval(
                  F.lit(0), F.lit(0), F.lit(0), F.lit(float(lateness_s))))
    return (meter.join(pdu, "bucket").where(closed)
                 .select(F.col("bucket").alias("timestamp"), F.try_divide("meter_W", "pdu_W").alias("ratio")))
