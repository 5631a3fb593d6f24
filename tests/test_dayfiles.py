"""Flat day files: two-phase writes, planned files, streams of loads."""

import datetime as dt
import glob
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import GreaterThanOrEqual, LessThan

from wattspark.sources import dayfiles as D, telemetry as TS

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id long, timestamp timestamp_ntz, value double"


def samples(spark, days, per_day=100, first=0):
    step = 86_400 // per_day
    return spark.range(days * per_day).select(
        F.col("id"), (F.lit(T0 + dt.timedelta(days=first)).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") * step)).alias("timestamp"),
        (F.col("id") % 7).cast("double").alias("value"))


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_round_trip_and_names(spark, tmpdir_path):
    path = f"{tmpdir_path}/events"
    df = samples(spark, 5)
    D.write_day_files(df, path, "events")
    names = {n.split("_", 1)[1] for n in os.listdir(path) if n.endswith(".parquet")}
    assert names == {f"2024-01-0{d}_2024-01-0{d + 1}.parquet" for d in range(1, 6)}
    assert f"events_2024-01-01_2024-01-02.parquet" in os.listdir(path) and not glob.glob(f"{path}/_staging*")
    back = D.read_day_files(spark, path)
    assert back.schema.simpleString() == df.schema.simpleString() and rows(back) == rows(df)
    # the plain scan reads the same files
    assert rows(TS.telemetry_scan(spark, path)) == rows(df)


def test_filters_choose_files_and_keep_rows(spark, tmpdir_path):
    path = f"{tmpdir_path}/events"
    df = samples(spark, 9)
    D.write_day_files(df, path, "events")
    lo, hi = T0 + dt.timedelta(days=3, hours=5), T0 + dt.timedelta(days=4, hours=2)
    reader = D.DayReader(path, df.schema, "timestamp")
    assert len(list(reader.pushFilters([GreaterThanOrEqual(("timestamp",), lo), LessThan(("timestamp",), hi), LessThan(("value",), 3.0)]))) == 3
    assert {D._day_range(n)[0].day for n in reader.planned()} == {4, 5}
    for back in (D.read_day_files(spark, path), D.read_day_files(spark, path, schema=SCHEMA)):
        cond = (F.col("timestamp") >= F.lit(lo).cast("timestamp_ntz")) & (F.col("timestamp") < F.lit(hi).cast("timestamp_ntz")) & (F.col("value") < 3)
        part = back.where(cond)
        assert rows(part) == rows(df.where(cond)) and part.rdd.getNumPartitions() < 9


def test_a_failed_task_leaves_no_file(spark, tmpdir_path):
    path = f"{tmpdir_path}/events"
    D.write_day_files(samples(spark, 2), path, "events")
    before = sorted(os.listdir(path))
    bad = samples(spark, 4).withColumn("value", F.when(F.col("id") == 399, F.raise_error(F.lit("torn"))).otherwise(F.col("value")).cast("double"))
    with pytest.raises(Exception, match="torn"):
        D.write_day_files(bad, path, "events")
    none = samples(spark, 4).withColumn("timestamp", F.when(F.col("id") != 7, F.col("timestamp")))
    with pytest.raises(Exception, match="have no day file"):
        D.write_day_files(none, path, "events")
    assert sorted(os.listdir(path)) == before and D.read_day_files(spark, path).count() == 200


def test_a_failed_commit_leaves_the_old_state(tmpdir_path, spark, monkeypatch):
    path = f"{tmpdir_path}/events"
    D.write_day_files(samples(spark, 2), path, "events")
    before = sorted(os.listdir(path))
    writer = D.DayWriter(path, "events", "timestamp", True)
    done = writer.write(iter(samples(spark, 3, first=1).toArrow().to_batches()))
    monkeypatch.setattr(D.Folder, "write_load", lambda self, entry: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError, match="full"):
        writer.commit([done, None])
    assert sorted(os.listdir(path)) == before


def test_append_and_overwrite(spark, tmpdir_path):
    path = f"{tmpdir_path}/events"
    a, b, c = samples(spark, 2), samples(spark, 2, first=1), samples(spark, 1, per_day=10)
    D.write_day_files(a, path, "events")
    D.write_day_files(b, path, "events")
    assert rows(D.read_day_files(spark, path)) == rows(a) + rows(b)
    D.write_day_files(a.where("false"), path, "events")
    assert D.Folder(path).loads() == [1, 2, 3]
    D.write_day_files(c, path, "events", mode="overwrite")
    assert rows(D.read_day_files(spark, path)) == rows(c)
    assert sum(n.endswith(".parquet") for n in os.listdir(path)) == len(D.Folder(path).files())


def test_files_of_other_writers(spark, tmpdir_path):
    path = f"{tmpdir_path}/events"
    a, b = samples(spark, 1), samples(spark, 1, first=1)
    a.coalesce(1).write.parquet(path)  # no day in its name: always read
    assert rows(D.read_day_files(spark, path)) == rows(a)
    D.write_day_files(b, path, "events")
    assert rows(D.read_day_files(spark, path).where("value < 100")) == rows(a) + rows(b)
    with pytest.raises(ValueError, match="pyarrow knows"):
        D.Folder("viewfs://cluster/events")


def test_stream_of_loads(spark, tmpdir_path):
    path, out, ck = f"{tmpdir_path}/events", f"{tmpdir_path}/out", f"{tmpdir_path}/ck"
    loads = [samples(spark, 2), samples(spark, 2, first=1), samples(spark, 1, first=9)]

    def run():
        q = (D.stream_day_files(spark, path, SCHEMA).writeStream.format("parquet").option("checkpointLocation", ck)
             .option("path", out).trigger(availableNow=True).start())
        q.awaitTermination()

    want = Counter()
    for k, load in enumerate(loads):
        D.write_day_files(load, path, "events")
        want += rows(load)
        if k != 1:
            run()  # the second run takes two loads
    run()
    assert rows(spark.read.parquet(out)) == want
