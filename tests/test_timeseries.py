"""Property tests: the scalable rewrites equal the naive forms."""

import datetime as dt
import random

from pyspark.sql import Window, functions as F

from wattspark.operators import timeseries as ts
from wattspark.operators.joins import range_join, interval_union_filter

T0 = dt.datetime(2024, 1, 1)


def _series(spark, n=400, hosts=3, seed=1, dup=True, nulls=True):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        t = T0 + dt.timedelta(seconds=rnd.randint(0, 5 * 86400), microseconds=rnd.randint(0, 999999))
        if dup and i % 17 == 0 and rows:
            t = rows[-1][1]
        v = None if (nulls and i % 23 == 0) else rnd.uniform(0, 500)
        rows.append((i, t, rnd.randrange(hosts), v))
    return spark.createDataFrame(rows, "id long, ts timestamp_ntz, host long, v double")


def _plain_lag(df, keys):
    w = Window.partitionBy(*keys).orderBy("ts", "id") if keys else Window.orderBy("ts", "id")
    return df.select("id", F.lag("v").over(w).alias("p"), F.lag("ts").over(w).alias("pt"))


def test_chunked_lag_equals_lag_keyed(spark):
    df = _series(spark)
    for chunk in (600, 3600, 86400):
        got = ts.chunked_lag(df, ["host"], "ts", ["v", "ts"], tiebreak=["id"], chunk_seconds=chunk)
        got = got.select("id", F.col("prev_v").alias("p"), F.col("prev_ts").alias("pt"))
        exp = _plain_lag(df, ["host"])
        assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0


def test_chunked_lag_equals_lag_keyless(spark):
    df = _series(spark, seed=3)
    got = ts.chunked_lag(df, [], "ts", ["v", "ts"], tiebreak=["id"], chunk_seconds=3600)
    got = got.select("id", F.col("prev_v").alias("p"), F.col("prev_ts").alias("pt"))
    exp = _plain_lag(df, [])
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0


def test_chunked_lag_without_tiebreak_equals_lag(spark):
    """The hash-aggregate path (order = timestamp only): unique timestamps, NULL timestamps first."""
    rnd = random.Random(7)
    secs = rnd.sample(range(0, 5 * 86400), 300)
    rows = [(i, T0 + dt.timedelta(seconds=s), i % 3, float(i)) for i, s in enumerate(secs)]
    rows += [(1000, None, 0, -1.0), (1001, None, 1, None)]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz, host long, v double")
    for keys in (["host"], []):
        got = ts.chunked_lag(df, keys, "ts", ["v", "ts"], chunk_seconds=3600)
        got = got.select("id", F.col("prev_v").alias("p"), F.col("prev_ts").alias("pt"))
        w = Window.partitionBy(*keys).orderBy(F.col("ts").asc_nulls_first()) if keys else \
            Window.orderBy(F.col("ts").asc_nulls_first())
        exp = df.select("id", F.lag("v").over(w).alias("p"), F.lag("ts").over(w).alias("pt"))
        if not keys:  # two NULL timestamps tie: compare the rows with a timestamp only
            got, exp = got.where(F.col("id") < 1000), exp.where(F.col("id") < 1000)
            first = sorted(rows[:300], key=lambda r: r[1])[0][0]
            got, exp = got.where(F.col("id") != first), exp.where(F.col("id") != first)
        assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0


def test_carried_null_stays_null(spark):
    """A real NULL on the last row of a chunk is carried as NULL, not skipped."""
    rows = [(1, T0, 0, 1.0), (2, T0 + dt.timedelta(minutes=59), 0, None), (3, T0 + dt.timedelta(hours=2), 0, 5.0)]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz, host long, v double")
    got = {r.id: r.prev_v for r in ts.chunked_lag(df, ["host"], "ts", ["v"], tiebreak=["id"]).collect()}
    assert got == {1: None, 2: 1.0, 3: None}


def test_chunked_row_number(spark):
    df = _series(spark, seed=5)
    got = ts.chunked_row_number(df, ["host"], "ts", tiebreak=["id"], chunk_seconds=7200, name="i")
    w = Window.partitionBy("host").orderBy("ts", "id")
    exp = df.select("id", (F.row_number().over(w) - 1).alias("i"))
    assert got.select("id", "i").exceptAll(exp).count() == 0


def test_diff_over_clips_resets(spark):
    rows = [(1, T0, "a", 10), (2, T0 + dt.timedelta(seconds=1), "a", 15), (3, T0 + dt.timedelta(seconds=2), "a", 3),
            (4, T0 + dt.timedelta(seconds=3), "a", 8)]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz, k string, c long")
    got = [r.c_rate for r in ts.diff_over(df, ["k"], "ts", ["c"]).orderBy("ts").collect()]
    assert got == [0, 5, 0, 5]


def test_tumbling_epoch_aligned_left_closed(spark):
    rows = [(T0 + dt.timedelta(minutes=9, seconds=59),), (T0 + dt.timedelta(minutes=10),), (T0,)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    got = ts.tumbling_agg(df, "ts", 600, [], [F.count(F.lit(1)).alias("n")]).orderBy("timestamp").collect()
    assert [(r.timestamp, r.n) for r in got] == [(T0, 2), (T0 + dt.timedelta(minutes=10), 1)]


def _intervals(spark, seed=7, n=40):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        s = T0 + dt.timedelta(seconds=rnd.randint(0, 5 * 86400))
        e = s + dt.timedelta(seconds=rnd.randint(-100, 40000))   # some end < start
        rows.append((i, rnd.randrange(3), s, e))
    return spark.createDataFrame(rows, "run_id long, host long, start timestamp_ntz, end timestamp_ntz")


def test_range_join_equals_naive(spark):
    pts, iv = _series(spark, nulls=False), _intervals(spark)
    for keys, pad in (([], 0), (["host"], 0), (["host"], 60)):
        got = range_join(pts, iv, point_ts="ts", start="start", end="end", keys=keys, pad_seconds=pad,
                         bucket_seconds=3600).select("id", "run_id")
        cond = (pts.ts >= iv.start - F.expr(f"interval {pad} seconds")) & \
               (pts.ts <= iv.end + F.expr(f"interval {pad} seconds"))
        for k in keys:
            cond = cond & (pts[k] == iv[k])
        exp = pts.join(iv, cond).select("id", "run_id")
        assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0


def test_interval_union_filter_no_duplicates(spark):
    pts, iv = _series(spark, nulls=False), _intervals(spark)
    got = interval_union_filter(pts, iv, point_ts="ts")
    exp = pts.join(iv, (pts.ts >= iv.start) & (pts.ts <= iv.end), "left_semi")
    assert got.count() == got.select("id").distinct().count()
    assert got.select("id").exceptAll(exp.select("id")).count() == 0
    assert exp.select("id").exceptAll(got.select("id")).count() == 0


def test_trim_ends(spark):
    rows = [(T0 + dt.timedelta(minutes=10 * i), float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, v double")
    assert sorted(r.v for r in ts.trim_ends(df, "timestamp").collect()) == [1.0, 2.0, 3.0]


def test_depth_lag_equals_lag_on_bursts(spark):
    """One second holds most samples; null keys and times, ties, several series."""
    from pyspark.sql import Window
    from wattspark.operators.timeseries import DEPTH, chunked_lag, depth_lag
    n = F.col("id")
    df = spark.range(20_000).select(
        n.alias("event_id"), F.when(n % 50 == 0, None).when(n % 3 == 0, "b").otherwise("a").alias("host"),
        F.when(n % 997 == 0, None).otherwise(F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.when(n % 10 == 0, n * 5_000_000).otherwise((n * 7919) % 1000)).cast("timestamp_ntz")).alias("timestamp"),
        ((n * 31) % 1000).cast("double").alias("value"))
    w = Window.partitionBy("host").orderBy(F.col("timestamp").asc_nulls_first(), "event_id")
    want = {r.event_id: (r.pv, r.pt) for r in df.select("event_id", F.lag("value").over(w).alias("pv"), F.lag("timestamp").over(w).alias("pt")).collect()}
    out = depth_lag(df, ["host"], "timestamp", ["value", "timestamp"], tiebreak=["event_id"], parts=16)
    assert out.columns == [*df.columns, "prev_value", "prev_timestamp"]
    assert {r.event_id: (r.prev_value, r.prev_timestamp) for r in out.collect()} == want
    keyless = chunked_lag(df, [], "timestamp", ["value"], tiebreak=["event_id"], chunk_seconds=DEPTH)
    w = Window.orderBy(F.col("timestamp").asc_nulls_first(), "event_id")
    want = {r.event_id: r.pv for r in df.select("event_id", F.lag("value").over(w).alias("pv")).collect()}
    assert {r.event_id: r.prev_value for r in keyless.collect()} == want


def test_a_burst_of_one_second_spreads_over_parts(spark, tmp_path, monkeypatch):
    from wattspark.operators import timeseries as ts
    monkeypatch.setattr(ts, "scratch_path", lambda spark, name: str(tmp_path / "depth"))
    n = F.col("id")
    df = spark.range(200_000).select(n.alias("event_id"), F.lit("a").alias("host"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + (n * 7919) % 1_000_000).cast("timestamp_ntz").alias("timestamp"), n.cast("double").alias("value"))
    ts.depth_lag(df, ["host"], "timestamp", ["value"], tiebreak=["event_id"], parts=8)
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "depth")).groupBy("__part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 200_000 / 8


def test_energy_in_parts_of_equal_depth(spark):
    from wattspark.operators import energy
    from wattspark.operators.timeseries import DEPTH
    n = F.col("id")
    df = spark.range(5000).select(n.alias("event_id"), (n % 3).alias("host"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + (n * 7919 % 5000) * 250_000).cast("timestamp_ntz").alias("timestamp"), ((n * 13) % 100).cast("double").alias("value"))
    a, b = (sorted((r.host, round(r.energy_J, 6)) for r in energy.integrate_power(df, "timestamp", "value", ["host"], tiebreak=["event_id"], chunk_seconds=c).collect()) for c in (None, DEPTH))
    assert a == b and len(a) == 3


def test_dyadic_join_equals_naive_join(spark):
    import random
    from wattspark.operators.joins import LEVELS, _bucket, dyadic_cells, dyadic_join
    rnd = random.Random(4)
    t0 = 1_700_000_000_000_000
    pts = [(i, f"h{i % 3}", t0 + rnd.randrange(40 * 86_400_000_000)) for i in range(2000)]
    iv = []
    for k in range(120):  # from a microsecond to a month, overlapping, some empty, null or backwards
        lo = t0 + rnd.randrange(40 * 86_400_000_000)
        size = rnd.choice([0, 1, 999_999, 1_000_000, 60_000_000, 3_600_000_000, 86_400_000_000, 30 * 86_400_000_000, -5])
        iv.append((k, f"h{k % 3}", lo, None if k % 40 == 7 else lo + size))
    iv += [(200 + k, f"h{k % 3}", t, t) for k, (_, _, t) in enumerate(pts[:30]) if pts[k][1] == f"h{k % 3}"]
    t = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    points = spark.createDataFrame(pts, "pid long, host string, us long").select("pid", "host", t("us").alias("ts"))
    spans = spark.createDataFrame(iv, "run long, host string, lo long, hi long").select("run", "host", t("lo").alias("start"), t("hi").alias("end"))
    for pad in (0.0, 0.5):
        p = int(pad * 1e6)
        want = sorted((i, k) for i, h, x in pts for k, g, lo, hi in iv if hi is not None and h == g and lo - p <= x <= hi + p and hi + p >= lo - p)
        got = dyadic_join(points, spans, point_ts="ts", start="start", end="end", keys=["host"], pad_seconds=pad)
        assert got.columns == ["pid", "host", "ts", "run", "start", "end"]
        assert sorted((r.pid, r.run) for r in got.select("pid", "run").collect()) == want
    # a month of seconds is a few dozen cells, which cover each second once
    one = spark.createDataFrame([(12_345, 12_345 + 2_678_400), (-7, 9), (5, 5)], "a long, b long").select("a", "b", dyadic_cells(F.col("a"), F.col("b")).alias("c")).collect()
    for r in one:
        assert len(r.c) <= 2 * LEVELS and sum(2 ** x.level for x in r.c) == r.b - r.a + 1
        assert min(x.cell * 2 ** x.level for x in r.c) == r.a and max((x.cell + 1) * 2 ** x.level for x in r.c) == r.b + 1
    assert len(one[0].c) < 45


def test_dyadic_join_broadcasts_no_cells(spark):
    """An interval of a year has some fifty cells: their broadcast took the driver's memory where that of the intervals fits."""
    from wattspark.operators.joins import dyadic_join
    points = spark.range(2000).selectExpr("id % 50 AS host", "timestamp_seconds(id * 15768)::timestamp_ntz AS ts", "id")
    spans = spark.range(50).selectExpr("id AS host", "timestamp_seconds(id * 7)::timestamp_ntz AS start", "timestamp_seconds(31536000 - id)::timestamp_ntz AS end", "id AS run")
    got = dyadic_join(points, spans, point_ts="ts", start="start", end="end", keys=["host"])
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.run, r.id) for r in got.select("run", "id").collect()) == sorted((i % 50, i) for i in range(2000) if i % 50 * 7 <= i * 15768 <= 31536000 - i % 50)
