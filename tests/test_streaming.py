"""Streaming equals batch: several ordered micro-batches give the batch totals."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from wattspark.operators import energy
from wattspark.operators.power import pue_series
from wattspark.sources import formats as FM
from wattspark.sources.snapshots import SnapshotTable
from wattspark.streaming import ingest as SI, stateful as SS, pue as SP

T0 = dt.datetime(2024, 1, 1)


def _rows(n=60):
    return [(T0 + dt.timedelta(seconds=7 * i, microseconds=1000 * (i % 5)), f"h{i % 2}", float(100 + (i * 37) % 50))
            for i in range(n)]


def _write_batches(spark, root, rows, parts=3):
    src = os.path.join(root, "in")
    os.makedirs(src, exist_ok=True)
    size = len(rows) // parts
    for b in range(parts):
        chunk = rows[b * size:(b + 1) * size]
        df = spark.createDataFrame(chunk, "timestamp timestamp_ntz, host string, value double")
        lp = df.select(FM.render_line_protocol(df, "p", ["host"], {"value": "float"}, "timestamp").alias("line"))
        tmp = os.path.join(root, f"tmp{b}")
        lp.coalesce(1).write.text(tmp)
        f = [x for x in os.listdir(tmp) if x.startswith("part-")][0]
        os.replace(os.path.join(tmp, f), os.path.join(src, f"batch{b}.txt"))
    return src


def test_stream_energy_multi_batch_equals_batch(spark, tmpdir_path):
    SI.enable_rocksdb(spark)
    rows = _rows()
    src = _write_batches(spark, tmpdir_path, rows)
    out = os.path.join(tmpdir_path, "out")
    s = SI.power_rows(SI.read_line_protocol_stream(spark, src, max_files_per_trigger=1))

    def sink(b, i):
        b.withColumn("batch_id", F.lit(i)).write.mode("append").parquet(out)
    q = (SS.stream_energy(s).writeStream.foreachBatch(sink)
         .option("checkpointLocation", os.path.join(tmpdir_path, "ck")).outputMode("update")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    res = spark.read.parquet(out)
    assert res.select("batch_id").distinct().count() == 3
    last = {r.host: r for r in res.groupBy("host").agg(F.max_by(F.struct("energy_J", "samples"), "batch_id").alias("s"))
            .select("host", "s.*").collect()}
    batch = spark.createDataFrame(rows, "timestamp timestamp_ntz, host string, value double")
    exp = {r.host: r.energy_J for r in energy.integrate_power(batch, "timestamp", "value", ["host"]).collect()}
    assert set(last) == set(exp)
    for h in exp:
        assert last[h].energy_J == pytest.approx(exp[h])
        assert last[h].samples == 30


def test_stream_windows_close_with_watermark(spark, tmpdir_path):
    rows = [(T0 + dt.timedelta(minutes=m), "h", 1.0) for m in (0, 5, 12, 25, 40)]
    src = _write_batches(spark, tmpdir_path, rows, parts=1)
    out = os.path.join(tmpdir_path, "win")
    agg = SI.tumbling_power(SI.power_rows(SI.read_line_protocol_stream(spark, src)), "10 minutes", "10 minutes")
    q = (agg.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", os.path.join(tmpdir_path, "ck2")).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted((r.window_start, r.n) for r in spark.read.parquet(out).collect())
    # watermark = 40 min - 10 min = 30 min: windows ending at or before 30 min are final
    assert [(w.replace(tzinfo=None), n) for w, n in got] == [(T0, 2), (T0 + dt.timedelta(minutes=10), 1),
                                                             (T0 + dt.timedelta(minutes=20), 1)]


def test_pue_partials_merge_exactly(spark, tmpdir_path):
    state = os.path.join(tmpdir_path, "partials")
    schema = "timestamp timestamp_ntz, kind string, device string, port string, value double"
    a = spark.createDataFrame([(T0 + dt.timedelta(minutes=1), "meter", "site", "-", 300.0),
                               (T0 + dt.timedelta(minutes=2), "pdu", "d1", "p", 100.0)], schema)
    b = spark.createDataFrame([(T0 + dt.timedelta(minutes=3), "pdu", "d2", "p", 100.0),
                               (T0 + dt.timedelta(minutes=40), "meter", "site", "-", 1.0)], schema)
    w = SP.partials_writer(state)
    w(a, 0)
    w(b, 1)
    w(a, 0)                                # a replayed batch is de-duplicated
    got = SP.pue_from_partials(spark, state).collect()
    assert [(r.timestamp, r.ratio) for r in got] == [(T0, 1.5)]


def _files(root, batches):
    """One CSV file per batch, in order of their times."""
    src = os.path.join(root, "in")
    os.makedirs(src, exist_ok=True)
    for b, rows in enumerate(batches):
        path = os.path.join(src, f"b{b}.csv")
        with open(path, "w") as f:
            f.writelines(f"{t.isoformat(sep=' ')},{','.join(map(str, rest))}\n" for t, *rest in rows)
        os.utime(path, (1e9 + 10 * b, 1e9 + 10 * b))
    return src


def _shuffled(n=500, delay=300, parts=5):
    """Samples in arrival order, each up to ``delay`` seconds behind a later one; ties and repeats included."""
    rnd = random.Random(3)
    rows = [(T0 + dt.timedelta(seconds=3 * i, microseconds=rnd.randrange(900_000)), f"h{i % 3}", float(rnd.randrange(200))) for i in range(n)]
    rows += [(t, h, v + 1) for t, h, v in rows[::50]] + rows[7:400:90]
    rows.sort(key=lambda r: r[0].timestamp() + rnd.random() * delay)
    size = -(-len(rows) // parts)
    return rows, [rows[k:k + size] for k in range(0, len(rows), size)]


def _read(spark, src):
    return spark.readStream.schema("timestamp timestamp, host string, value double").option("maxFilesPerTrigger", 1).csv(src)


@pytest.mark.parametrize("small", [4096, 8])  # 8: series are kept in slices
def test_energy_of_shuffled_samples_equals_batch(spark, tmpdir_path, small):
    SI.enable_rocksdb(spark)
    rows, batches = _shuffled()
    batches[-1] = batches[-1] + [(T0, "h0", 1e6), (T0 + dt.timedelta(seconds=1), "h0", 1e6)]  # far too late
    src, out = _files(tmpdir_path, batches), os.path.join(tmpdir_path, "out")

    def sink(b, i):
        b.withColumn("batch_id", F.lit(i)).write.mode("append").parquet(out)
    q = (SS.stream_energy(_read(spark, src), delay="300 seconds", small=small).writeStream.foreachBatch(sink)
         .option("checkpointLocation", os.path.join(tmpdir_path, "ck")).outputMode("update").trigger(availableNow=True).start())
    q.awaitTermination()
    final = [r for r in rows if r[0] <= max(x[0] for x in rows) - dt.timedelta(seconds=300)]
    batch = spark.createDataFrame(final, "timestamp timestamp_ntz, host string, value double")
    want = {r.host: r.energy_J for r in energy.integrate_power(batch, "timestamp", "value", ["host"], tiebreak=["value"]).collect()}
    got = {r.host: r for r in spark.read.parquet(out).groupBy("host").agg(F.max_by(F.struct("energy_J", "samples", "late_samples"), "batch_id").alias("s")).select("host", "s.*").collect()}
    assert set(got) == set(want)
    for h, r in got.items():
        assert r.energy_J == pytest.approx(want[h])
        assert r.samples == sum(x[1] == h for x in final) and r.late_samples == (2 if h == "h0" else 0)
    # state holds what is not final, not the history
    held = [json.loads(p.json)["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress]
    assert held[-1] < 40


def test_counter_rates_of_shuffled_samples_equal_batch(spark, tmpdir_path):
    SI.enable_rocksdb(spark)
    rows, batches = _shuffled()
    batches[-1] = batches[-1] + [(T0, "h1", 5.0)]
    src, out = _files(tmpdir_path, batches), os.path.join(tmpdir_path, "out")
    q = (SS.stream_counter_rate(_read(spark, src), delay="300 seconds", small=20).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", os.path.join(tmpdir_path, "ck")).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    final = max(x[0] for x in rows) - dt.timedelta(seconds=300)
    want = []
    for h in ("h0", "h1", "h2"):
        s = sorted((t, v) for t, k, v in rows if k == h and t <= final)
        want += [(h, t, max(v - (s[i - 1][1] if i else v), 0.0)) for i, (t, v) in enumerate(s)]
    out = spark.read.parquet(out).select("host", F.col("timestamp").cast("timestamp_ntz").alias("t"), "rate", "late").collect()
    assert sorted((r.host, r.t, r.rate) for r in out if not r.late) == sorted(want)
    assert [(r.host, r.t) for r in out if r.late] == [("h1", T0)]


def test_silent_series_are_forgotten(spark, tmpdir_path):
    SI.enable_rocksdb(spark)
    at = lambda m: T0 + dt.timedelta(minutes=m)
    batches = [[(at(0), "a", 5.0), (at(1), "b", 1.0)], [(at(30), "b", 4.0)], [(at(60), "b", 6.0)], [(at(61), "a", 9.0), (at(62), "b", 6.5)], [(at(90), "b", 7.0)]]
    src, out = _files(tmpdir_path, batches), os.path.join(tmpdir_path, "out")
    q = (SS.stream_counter_rate(_read(spark, src), forget_ms=40 * 60_000).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", os.path.join(tmpdir_path, "ck")).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted((r.host, r.rate) for r in spark.read.parquet(out).collect())
    assert got == [("a", 0.0), ("a", 0.0), ("b", 0.0), ("b", 0.5), ("b", 0.5), ("b", 2.0), ("b", 3.0)]  # not 4.0 from the old value of a


def test_joined_pue_streams_equal_batch_over_restarts(spark, tmpdir_path):
    rnd = random.Random(5)
    rows = []
    for i in range(600):
        t = T0 + dt.timedelta(seconds=17 * i)
        rows.append((t, "meter", "site", "-", 1000.0 + rnd.randrange(100)) if i % 3 == 0 else (t, "pdu", f"d{i % 4}", f"p{i % 2}", 100.0 + rnd.randrange(50)))
    arrived = sorted(rows, key=lambda r: r[0].timestamp() + rnd.random() * 500)
    out, ck = os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ck")

    def run(batches):
        src = _files(tmpdir_path, batches)
        s = spark.readStream.schema("timestamp timestamp, kind string, device string, port string, value double").option("maxFilesPerTrigger", 1).csv(src)
        pue = SP.stream_pue(s.where("kind = 'meter'"), s.where("kind = 'pdu'"))
        q = pue.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()

    thirds = [arrived[:200], arrived[200:400], arrived[400:]]
    run(thirds[:2])
    run(thirds)  # a restart, with one more file
    seen = min(max(r[0] for r in rows if r[1] == k) for k in ("meter", "pdu"))
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, kind string, device string, port string, value double")
    batch = pue_series(df.where("kind = 'meter'").select("timestamp", F.lit("m").alias("description"), "value"),
                       df.where("kind = 'pdu'").select("timestamp", F.col("device").alias("connected_device"), "port", F.col("value").alias("value_W")), "m")
    want = {r.timestamp: r.ratio for r in batch.collect() if r.timestamp + dt.timedelta(minutes=20) <= seen}
    got = [(r.t, r.ratio) for r in spark.read.parquet(out).select(F.col("timestamp").cast("timestamp_ntz").alias("t"), "ratio").collect()]
    assert len(got) == len(dict(got)) == len(want) > 10
    assert all(v == pytest.approx(want[t]) for t, v in got)


def test_pue_partials_are_compacted(spark, tmpdir_path):
    state = os.path.join(tmpdir_path, "partials")
    rows = [(T0 + dt.timedelta(minutes=m), k, d, "p", 10.0 * m + len(d)) for m in range(0, 90, 3) for k, d in (("meter", "site"), ("pdu", "d1"), ("pdu", "d2"))]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, kind string, device string, port string, value double")
    once, often = SP.partials_writer(state + "1"), SP.partials_writer(state + "2", compact_every=3)
    once(df, 0)
    for b in range(6):
        part = df.where(F.pmod(F.minute("timestamp") / 3, F.lit(6)) == b)
        often(part, b)
        often(part, b)  # replayed
    table = SnapshotTable(spark, state + "2")
    assert len(table.entry()["loads"]) < 3
    key = lambda r: (r.timestamp, round(r.ratio, 9))
    assert sorted(map(key, SP.pue_from_partials(spark, state + "1").collect())) == sorted(map(key, SP.pue_from_partials(spark, state + "2").collect()))


class _Store:
    """A state store that counts its calls."""

    def __init__(self):
        self.calls, self.timers, self.of = 0, set(), {}

    def getValueState(self, name, *schemas):
        return _Kept(self, self.of.setdefault(name, {}))

    getMapState = getValueState

    def registerTimer(self, t):
        self.timers.add(t)

    def deleteTimer(self, t):
        self.timers.discard(t)


class _Kept:
    def __init__(self, store, rows):
        self.store, self.rows = store, rows

    def _count(self):
        self.store.calls += 1
        return self.rows

    def get(self):
        return self._count().get(())

    def update(self, v):
        self._count()[()] = v

    def clear(self):
        self._count().clear()

    def getValue(self, k):
        return self._count().get(k)

    def updateValue(self, k, v):
        self._count()[k] = v

    def removeKey(self, k):
        self._count().pop(k)

    def keys(self):
        return iter(list(self._count()))


class _Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def _run_processor(processor, frames, mark_us):
    import pandas as pd
    store = _Store()
    processor.init(store)
    out = list(processor.handleInputRows((0,), iter(frames), _Mark(0)))
    out += list(processor.handleExpiredTimer((0,), _Mark(mark_us // 1000), None))
    return store.calls, pd.concat(out)


def test_state_calls_of_a_hot_series_follow_time_not_samples():
    """Every frame of a hot series wrote each minute that it held a sample of."""
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(1)
    day, n = 86_400_000_000, 60_000
    us, value = rng.integers(0, 2 * day, n), rng.integers(0, 100, n).astype(float)
    pdf = pd.DataFrame({"host": "a", "us": us, "value": value})
    frames = [pdf[k:k + 10_000] for k in range(0, n, 10_000)]
    calls, out = _run_processor(SS.CounterRateProcessor(), frames, day)
    assert calls < 400
    order = np.lexsort((value, us))
    order = order[us[order] <= day]
    want = np.clip(np.diff(np.concatenate([value[order[:1]], value[order]])), 0, None)
    assert (out["rate"].to_numpy() == want).all() and not out["late"].any()
    parts, again = _run_processor(SS.CounterRateProcessor(flush=15_000), frames, day)  # slices in several parts
    assert parts > calls and again.reset_index(drop=True).equals(out.reset_index(drop=True))


def test_state_calls_do_not_follow_the_span_of_time():
    """Samples over years went to a slice for every hour, each with four calls."""
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(2)
    year, n = 365 * 86_400_000_000, 60_000
    us, value, host = rng.integers(0, 2 * year, n), rng.integers(0, 100, n).astype(float), rng.integers(0, 3, n)
    us[::7] = us[3]  # ties, also where slices meet
    pdf = pd.DataFrame({"host": [f"h{h}" for h in host], "us": us, "value": value})
    frames = [pdf[k:k + 10_000] for k in range(0, n, 10_000)]
    for processor, most in ((SS.CounterRateProcessor(), 30), (SS.CounterRateProcessor(flush=15_000), 40), (SS.CounterRateProcessor(small=500), 400)):
        calls, out = _run_processor(processor, frames, year)
        assert calls < most
        for h in range(3):
            mine = np.flatnonzero((host == h) & (us <= year // 1000 * 1000))
            mine = mine[np.lexsort((value[mine], us[mine]))]
            got = out[out["host"] == f"h{h}"]
            assert (got["timestamp"].to_numpy().astype("datetime64[us]").astype("int64") == us[mine]).all()
            assert (got["rate"].to_numpy() == np.clip(np.diff(value[mine], prepend=value[mine[0]]), 0, None)).all()


def test_state_calls_of_many_series_follow_their_groups():
    """Each series had some ten state calls and four pandas frames in every batch."""
    import numpy as np
    import pandas as pd
    n = 3000
    us = np.arange(n) * 1_000_000
    pdf = pd.DataFrame({"host": [f"h{i % 1000}" for i in range(n)], "us": us, "value": 2.0})
    calls, out = _run_processor(SS.EnergyProcessor(), [pdf], int(us[-1]))
    assert calls < 20
    assert sorted(out["host"]) == sorted(f"h{i}" for i in range(1000))
    assert (out["samples"] == 3).all() and (out["energy_J"] == 4000.0).all() and (out["late_samples"] == 0).all()


def test_shuffled_stream_input_is_written_by_many_tasks(spark, monkeypatch, tmpdir_path):
    """Every arrival was one file, sorted and written by one task."""
    from wattspark.plans import queries as Q
    monkeypatch.setattr(Q, "FILE_ROWS", 100)
    folder = os.path.join(tmpdir_path, "in")
    monkeypatch.setattr(Q, "_scratch", lambda spark, name: folder if name == "stream-in" else os.path.join(tmpdir_path, name))
    rows = spark.range(3000).selectExpr("timestamp_seconds(id)::timestamp_ntz AS timestamp", "concat('h', id % 3) AS host", "id * 1.0D AS value")
    parsed, delay = Q._shuffled_stream(spark, rows, "p", ["host"], {"value": "float"}, batches=3)
    assert len([f for f in os.listdir(folder) if f.startswith("part-")]) > 4 * 5
    seen = []
    q = SI.power_rows(parsed).writeStream.foreachBatch(lambda b, i: seen.append(b.selectExpr("min(unix_seconds(timestamp::timestamp))", "max(unix_seconds(timestamp::timestamp))", "count(*)").first())).option("checkpointLocation", os.path.join(tmpdir_path, "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r[2] for r in seen) == 3000 and len(seen) >= 4
    limit, newest = int(delay.split()[0]), 0
    for lo, hi, _ in seen:  # no sample comes later than the delay
        assert lo >= newest - limit
        newest = max(newest, hi)
