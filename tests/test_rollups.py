"""Rollups kept by a stream and sketches per day: equal to direct queries, whatever the order and the batches."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from wattspark.functions.timecols import bucket_start
from wattspark.operators import sketches as SK
from wattspark.sources.snapshots import Conflict, SnapshotTable
from wattspark.streaming.rollup import FAN, Rollup

START = dt.datetime(2024, 3, 1)


def _samples(spark, n=4000):
    t = (F.lit(START) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("id") * 13 % n).cast("decimal(18,6)"))).cast("timestamp_ntz")
    return spark.range(n).select(t.alias("timestamp"), F.when(F.col("id") % 7 < 6, F.concat(F.lit("h"), F.col("id") % 3)).alias("host"),
                                 F.when(F.col("id") % 11 > 0, F.col("id") % 97 / 4).alias("value"))


def _direct(df, every):
    rows = df.where("timestamp IS NOT NULL").groupBy("host", bucket_start("timestamp", every).alias("b")).agg(F.count(F.lit(1)), F.count("value"), F.sum("value"), F.min("value"), F.max("value")).collect()
    return sorted(map(tuple, rows), key=str)


def _asked(df):
    return sorted(map(tuple, df.select("host", "timestamp", "rows", "n_value", "sum_value", "min_value", "max_value").collect()), key=str)


def test_rollup_of_shuffled_and_repeated_batches_equals_the_direct_query(spark, tmpdir_path):
    s = _samples(spark)
    roll = Rollup(spark, os.path.join(tmpdir_path, "r"), ["host"], ["value"])
    write = roll.writer("q")
    for k in range(6):  # each batch holds samples of all times
        write(s.where(F.pmod(F.xxhash64("timestamp"), F.lit(6)) == k), k)
    for k in (0, 5):    # replayed batches, before and after a fold
        write(s.where(F.pmod(F.xxhash64("timestamp"), F.lit(6)) == k), k)
    for every in (60, 600, 3600):
        assert _asked(roll.query(every)) == _direct(s, every)
    loads = roll.table.entry()["loads"]
    assert len(loads) < FAN and roll.table.entry()["tokens"] == [f"q-{k}" for k in range(6)]
    write(s.where("false"), 6)
    assert _asked(roll.query(600)) == _direct(s, 600)


def test_rollup_spans_and_hosts(spark, tmpdir_path):
    s = _samples(spark).unionByName(spark.createDataFrame([(None, "h0", 1.0)], "timestamp timestamp_ntz, host string, value double"))
    roll = Rollup(spark, os.path.join(tmpdir_path, "r"), ["host"], ["value"])
    roll.add(s)
    lo, hi = START + dt.timedelta(minutes=10), START + dt.timedelta(minutes=40)
    inside = s.where((F.col("timestamp") >= F.lit(lo).cast("timestamp_ntz")) & (F.col("timestamp") < F.lit(hi).cast("timestamp_ntz")))
    assert _asked(roll.query(600, lo, hi)) == _direct(inside, 600)
    assert _asked(roll.query(600, lo, hi, host=["h1"])) == _direct(inside.where("host = 'h1'"), 600)
    with pytest.raises(ValueError):
        roll.query(90)
    with pytest.raises(ValueError):
        roll.query(60, lo + dt.timedelta(seconds=1))


def test_folding_rewrites_a_row_a_logarithmic_number_of_times(spark, tmpdir_path):
    roll = Rollup(spark, os.path.join(tmpdir_path, "r"), ["host"], ["value"])
    n, written = 16, 0
    for k in range(n):
        t = START + dt.timedelta(minutes=k)
        roll.add(spark.createDataFrame([(t, "h", 1.0)], "timestamp timestamp_ntz, host string, value double"), f"b-{k}")
    for e in roll.table.history().collect():
        written += e.added_rows
    assert len(roll.table.entry()["loads"]) == 1 and roll.query().count() == n
    assert written == 3 * n  # once loaded, once folded by four, once by sixteen


def test_replacing_loads_keeps_what_came_in_between(spark, tmpdir_path):
    t = SnapshotTable(spark, os.path.join(tmpdir_path, "t"))
    for k in range(3):
        t.load(spark.range(k, k + 1).toDF("id"))
    a, b, c = (x["load"] for x in t.entry()["loads"])
    t.replace_loads([b, c], t.read_loads([b, c]))
    assert sorted(r.id for r in t.read().collect()) == [0, 1, 2]
    assert t.entry()["loads"][0]["load"] == a
    with pytest.raises(Conflict):
        t.replace_loads([b], spark.range(1).toDF("id"))
    assert sorted(r.id for r in t.read().collect()) == [0, 1, 2]


def test_sketches_of_days_merge_to_the_summary_of_all(spark, tmpdir_path):
    n = 20000
    df = spark.range(n).select((F.lit(START) + F.make_dt_interval(F.col("id").cast("int") % 5)).cast("timestamp_ntz").alias("timestamp"),
                               F.when(F.col("id") % 10 > 0, F.col("id") * 7919 % n + 1e9).alias("v"), F.lit(None).cast("double").alias("none"))
    t = SK.SketchTable(spark, os.path.join(tmpdir_path, "s"), ["v", "none"])
    t.add(df.where("day(timestamp) < 5"), "a")
    t.add(df.where("day(timestamp) < 5"), "a")   # not twice
    t.add(df.where("day(timestamp) = 5"), "b")
    got = {r.col: r for r in t.summary(qs={"p10": 0.1, "median": 0.5, "p99": 0.99}).collect()}
    v, none = got["v"], got["none"]
    exact = sorted(r.v for r in df.where("v IS NOT NULL").collect())
    want = df.agg(F.avg("v"), F.stddev("v")).first()
    assert (v.n, v.nulls, v.min, v.max) == (len(exact), n - len(exact), exact[0], exact[-1])
    assert v.mean == pytest.approx(want[0], rel=1e-12) and v.std == pytest.approx(want[1], rel=1e-9)
    for name, q in (("p10", 0.1), ("median", 0.5), ("p99", 0.99)):
        below = sum(x < v[name] for x in exact)
        assert abs(below / len(exact) - q) < 0.012
    assert abs(v.distinct - len(set(exact))) < 0.03 * len(exact)
    assert (none.n, none.nulls, none.distinct, none["mean"], none["std"], none["median"]) == (0, n, 0, None, None, None)
    one = {r.col: r for r in t.summary(dt.date(2024, 3, 2), dt.date(2024, 3, 3)).collect()}["v"]
    assert one.n == df.where("day(timestamp) = 2 AND v IS NOT NULL").count()


def test_an_appended_day_reads_that_day_only(spark, tmpdir_path):
    t = SK.SketchTable(spark, os.path.join(tmpdir_path, "s"), ["v"])
    day = lambda k: spark.createDataFrame([(START + dt.timedelta(days=k), float(k))], "timestamp timestamp_ntz, v double")
    for k in range(3):
        t.add(day(k), f"day-{k}")
    assert t.table.plan({"day": (dt.date(2024, 3, 3), None)}).count() == 1
    assert t.table.entry()["added_rows"] == 1
    r = t.summary().first()
    assert (r.n, r["min"], r["max"], r["mean"]) == (3, 0.0, 2.0, 1.0)
