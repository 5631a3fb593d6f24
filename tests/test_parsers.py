"""Parser tests on small hand-written samples."""

import datetime as dt
import os

from pyspark.sql import functions as F

from tests.conftest import FIXTURES
from wattspark.sources import textlogs as TL, formats as FM


def test_ior_summaries(spark):
    c = TL.read_corpus(spark, os.path.join(FIXTURES, "ior"), "*_summary.txt_*")
    rows = {(r.scenario, r.api, r.run_id): r for r in TL.parse_ior_summaries(c).collect()}
    assert set(rows) == {("read_seq_1m", "POSIX", 3), ("writeread_rand_8k", "MPIIO", 1)}
    r = rows[("read_seq_1m", "POSIX", 3)]
    assert (r.fs_type, r.bw_MiB, r.iops) == ("nvme", 1200.5, 1200.5)
    # mixed write+read: the first result row (write) is taken
    assert rows[("writeread_rand_8k", "MPIIO", 1)].bw_MiB == 0.15


def test_tsdb_query_logs_optional_leading_line(spark):
    c = TL.read_corpus(spark, os.path.join(FIXTURES, "tsdb"), "*_query_*")
    rows = {r.db: r for r in TL.parse_tsdb_query_logs(c).collect()}
    q = rows["questdb"]
    assert (q.ram, q.cpus, q.iter, q.queries, q.workers, q.rate_qps) == (8, 4, 1, 500, 2, 400.25)
    assert (q.min_ms, q.med_ms, q.mean_ms, q.max_ms, q.stddev_ms, q["count"], q.wall_s) == (
        1.0, 2.0, 2.5, 20.0, 1.5, 500, 1.25)
    i = rows["influx"]   # thousands separator in the rate
    assert (i.ram, i.cpus, i.iter, i.rate_qps, i.sum_s) == (16, 8, 2, 1234.5, 1.3)


def test_tsdb_load_logs_thousands_and_missing(spark):
    lines = TL.read_lines(spark, os.path.join(FIXTURES, "tsdb"), "*_load_*")
    rows = TL.parse_tsdb_load_logs(lines).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.db, r.ram, r.cpus, r.iter, r.rows_per_sec, r.unit) == ("timescale", 32, 16, 3, 822670.70, "metrics/sec")


def test_llm_logs(spark):
    lines = TL.read_lines(spark, os.path.join(FIXTURES, "llm"))
    req = TL.parse_llm_requests(lines).orderBy("line_no").collect()
    assert [(r.model, r.max_tokens, r.prompt_tokens, r.completion_tokens, r.total_tokens, r.seconds) for r in req] == [
        ("Model-A", 1200, 40, 800, 840, 20.5), ("Model-A", 1500, 35, 900, 935, 22.0)]
    ev = {r.status: r for r in TL.parse_llm_run_events(lines).collect()}
    assert ev["START"].job == "42" and ev["START"].nodes == "node01" and ev["END"].job is None
    assert ev["END"].logged_at == dt.datetime(2026, 3, 1, 10, 15, 0)
    tot = TL.parse_llm_run_totals(lines).collect()[0]          # last status row wins
    assert (tot.requests, tot.failures, tot.failure_pct, tot.med_ms) == (12, 2, 16.67, 19000)
    pct = TL.parse_llm_percentiles(lines).collect()[0]
    assert (pct.p50, pct.p95, pct.p100, pct.n) == (19000, 22000, 28000, 12)
    err = TL.parse_llm_errors(lines).collect()
    assert [(e.occurrences, e.error.startswith("POST Model-A")) for e in err] == [(2, True)]


def test_line_protocol_escapes_types_and_time(spark):
    lines = TL.read_lines(spark, FIXTURES, "lines.lp")
    p = FM.parse_line_protocol(lines).orderBy("line_no").collect()
    assert [r.measurement for r in p] == ["pdu_power", "ipmi_power", "cpu"]
    assert p[0].tags == {"pdu": "rack 1", "outlet_num": "3", "connected_device": "dev,x", "port": "a=b"}
    assert p[0].time == dt.datetime(2024, 1, 1)
    assert p[1].time is None
    assert p[2].time == dt.datetime(2024, 1, 1, 0, 0, 1, 0)  # ns truncated to us
    typed = FM.parse_line_protocol(lines).select(
        "line_no", FM.field_long("fields", "value_W").alias("i"), FM.field_double("fields", "value").alias("d"),
        FM.field_string("fields", "state").alias("s")).orderBy("line_no").collect()
    assert (typed[0].i, typed[1].d, typed[2].s) == (42, 215.5, "ok, fine")


def test_render_parse_roundtrip(spark):
    rows = [("a b,c=d\\e", 1, 2.5, dt.datetime(2024, 1, 2, 3, 4, 5, 678901))]
    df = spark.createDataFrame(rows, "tag string, n long, x double, ts timestamp_ntz")
    lp = df.select(FM.render_line_protocol(df, "m", ["tag"], {"n": "int", "x": "float"}, "ts").alias("line"))
    r = FM.parse_line_protocol(lp).select(F.col("tags")["tag"].alias("tag"), FM.field_long("fields", "n").alias("n"),
                                          FM.field_double("fields", "x").alias("x"), "time").first()
    assert (r.tag, r.n, r.x, r.time) == rows[0]


def test_pdu_csv(spark):
    lines = spark.createDataFrame([
        ("f", 1, "pdu-name,power-outlet-num,connected-device,connected-port,value"),
        ("f", 2, "pduA,1,dev1,A,120\r"), ("f", 3, "pduA,2,dev1,B,null"), ("f", 4, "pduA,3,dev2,A,"),
        ("f", 5, "pduA,4,dev2,B,99.5")], "path string, line_no long, line string")
    got = [(r.connected_device, r.port, r.value_W, r.is_int) for r in FM.parse_pdu_csv(lines).orderBy("line_no").collect()]
    assert got == [("dev1", "A", 120.0, True), ("dev2", "B", 99.5, False)]


def test_sensor_csv_and_psu(spark):
    s = spark.createDataFrame([("f", 1, "h", "1,'CPU1 Temp',45.00,C,'OK'"), ("f", 2, "h", "2,'Fan 1',N/A,RPM,'N/A'")],
                              "path string, line_no long, host string, line string")
    assert [(r.name, r.unit, r.value) for r in FM.parse_ipmi_sensor_csv(s).collect()] == [("CPU1_Temp", "C", 45.0)]
    p = spark.createDataFrame([("f", 1, "h", 0, "  Instantaneous Power  : 215 W"), ("f", 2, "h", 0, "Peak Time : 12:00:01"),
                               ("f", 3, "h", 1, "Cumulative Energy : N/A")],
                              "path string, line_no long, host string, psu_id int, line string")
    got = [(r.type, r.value, r.unit) for r in FM.parse_psu_readings(p).orderBy("line_no").collect()]
    # split on ':' keeps only the hour of a clock reading, which is numeric: kept, no unit
    assert got == [("Instantaneous_Power", 215.0, "W"), ("Peak_Time", 12.0, None)]


def test_meter_json(spark):
    doc = ('{"vcIds": [1, "2", "x", 7], "v1": {"name": "P tot", "data": 12.5, "unit": {"unit": "kW"}, '
           '"lastUpdate": "05032026101112"}, "v2": {"name": "E", "data": 3, "unit": {}, "lastUpdate": "bad"}}')
    rows = FM.parse_meter_json(spark.createDataFrame([(doc,)], "payload string")).orderBy("vcid").collect()
    assert [(r.vcid, r.name, r.data, r.unit, r.timestamp) for r in rows] == [
        (1, "P tot", 12.5, "kW", "2026-03-05T10:11:12"), (2, "E", 3.0, None, "")]
    assert rows[0].ts == dt.datetime(2026, 3, 5, 10, 11, 12)


def test_prometheus_text(spark):
    lines = spark.createDataFrame([("f", 1, "# Active power"), ("f", 2, 'vcId_3{unit="W"} 1500.5'),
                                   ("f", 3, 'vcId_4{unit=""} 7'), ("f", 4, "#  Energy"), ("f", 5, 'vcId_5{unit="Wh"} 9')],
                                  "path string, line_no long, line string")
    got = [(r.description, r.vcID, r.unit, r.value) for r in FM.parse_prometheus_text(lines).orderBy("line_no").collect()]
    assert got == [("Active power", "3", "W", 1500.5), ("Active power", "4", None, 7.0), ("Energy", "5", "Wh", 9.0)]
